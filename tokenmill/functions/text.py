"""Text expressions. All are native Columns, so they stay in the JVM and need no shuffle.

The regular expressions spell out the whitespace, digit and word classes instead of using ``\\s``,
``\\d`` and ``\\b``: Java's shorthands are ASCII or version dependent, the texts are not.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import fixed

# Inside of a character class: Unicode whitespace, line separators, word characters.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
WORD = r"\p{L}\p{N}_"
OTHER_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)

FOLDED = {"i": "İı", "k": "\u212a", "s": "ſ"}  # letters that fold to plain ones, beside their upper case


def any_case(words: list[str]) -> str:
    """Any of ``words`` in any case. Beginnings are shared, so a letter is looked at once and not once for each word; of a
    word and a longer one that begins with it, the longer is tried first."""
    ends: dict[str, list[str]] = {}
    for w in words:
        ends.setdefault(w[:1], []).append(w[1:])
    parts = [_letter(c) + any_case(rest) if c else "" for c, rest in sorted(ends.items(), reverse=True)]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _letter(c: str) -> str:
    return f"[{c}{c.upper()}{FOLDED.get(c, '')}]" if c.isalpha() else c


def whole_words(words: list[str]) -> str:
    """Any of ``words``, in any case, not touching another word character.

    The looks at the first letter and at a plain letter before it are cheap and rule out most places.
    """
    first = "".join(sorted({_letter(w[0])[1:-1] for w in words}))
    return rf"(?<![a-zA-Z])(?=[{first}])(?<![{WORD}]){any_case(words)}(?![{WORD}])"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def plain_spaces(c: Column) -> Column:
    """Every kind of whitespace as a blank: one pass, and the patterns after it are simple and fast."""
    return F.translate(c, SPACES, " " * len(SPACES))


def single_blanks(c: Column) -> Column:
    """Runs of blanks as one. Halving runs three times leaves only long ones to the pattern."""
    for _ in range(3):
        c = F.replace(c, F.lit("  "), F.lit(" "))
    return let(c, lambda t: F.when(t.contains("  "), F.regexp_replace(t, "  +", " ")).otherwise(t))


def squeeze(c: Column) -> Column:
    return F.btrim(F.regexp_replace(plain_spaces(c), " +", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(plain_spaces(c), F.lit("[^ ]+"))


def token_estimate(c: Column) -> Column:
    return (F.floor(word_count(c) * F.lit(1.3)) + 1).cast("bigint")


def prompt_key(c: Column) -> Column:
    return F.sha2(c, 256)


def normalise_prompt(c: Column) -> Column:
    return strip(F.lower(F.replace(c, F.lit("\n"), F.lit(" "))))


# ------------------------------------------------------------------------------------- signatures
def digit_signature(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\p{Nd}+)"))))


def toggle_signature(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-zA-Z]+)"))
    return F.array_sort(F.array_intersect(words, F.array(*map(F.lit, fixed.TOGGLE_WORDS))))


def code_override(c: Column) -> Column:
    """True where the prompt names a code word as a token, or a code stem inside any token.

    Plain searches find stems and the texts with a word anywhere; only these meet the word's pattern, which looks around the word.
    """
    token = lambda t, w: t.contains(w) & t.rlike(rf"{w}(?<![a-zA-Z0-9]{w})(?![a-zA-Z0-9])")
    named = lambda t: reduce(or_, [t.contains(s) for s in fixed.CODE_STEMS] + [token(t, w) for w in fixed.CODE_WORDS])
    return let(normalise_prompt(c), named)


# ------------------------------------------------------------------------------------ cache bypass
def _phrase(p: str) -> str:
    quoted = re.escape(p).replace("\\ ", " ")
    head = rf"(?<![{WORD}])" if p[0].isalnum() else ""
    tail = rf"(?![{WORD}])" if p[-1].isalnum() else ""
    return head + quoted + tail


BYPASS_PHRASE = "(?:" + "|".join(map(_phrase, fixed.BYPASS_PHRASES)) + ")"
# a wish never begins between two letters, and most places are
BYPASS = rf"(?iu)(?<![a-zA-Z](?=[a-zA-Z]))[,;:\-{WS}]*[(\[{{\-]*[{WS}]*{BYPASS_PHRASE}[{WS}]*[)\]}}]*[,;:!?.\-{WS}]*"


def is_bypass(c: Column) -> Column:
    """Every phrase holds one of two cheap fragments, so most texts never meet the pattern."""
    some = let(F.lower(c), lambda low: low.contains("cache") | low.contains("force refre"))
    return some & c.rlike("(?iu)" + BYPASS_PHRASE)


def strip_bypass(c: Column) -> Column:
    """The prompt without its bypass wish. The separators around it go too, so neighbours may join."""
    cleaned = squeeze(F.regexp_replace(c, BYPASS, ""))
    # named once and in a branch, so it is only worked out for texts with a wish
    return F.when(is_bypass(c), let(cleaned, lambda t: F.when(t != "", t).otherwise(c))).otherwise(c)


# -------------------------------------------------------------------------------- log line filter
def strip_terminal(c: Column) -> Column:
    """Without colour codes and progress bars."""
    ws, digits = f"[{WS}]", r"\p{Nd}"
    patterns = {p.replace(r"\s", ws).replace(r"\d", digits): signs for p, signs in (
        (fixed.ANSI_ESCAPE, ["\x1b"]), (fixed.PROGRESS_BRACKET, ["[", "%"]), (fixed.PROGRESS_BLOCKS, ["%", "|"]))}
    # a pattern is only looked for in texts that hold its signs, which is a plain test
    steps = F.array(*[F.struct(F.lit(p).alias("pattern"), F.array(*map(F.lit, signs)).alias("signs")) for p, signs in patterns.items()])
    there = lambda t, s: F.forall(s.signs, lambda x: F.contains(t, x))
    return F.aggregate(steps, c, lambda t, s: F.when(there(t, s), F.regexp_replace(t, s.pattern, F.lit(""))).otherwise(t))


def split_lines(c: Column) -> Column:
    """Lines without their ends; only texts with other ends than line feeds meet the pattern."""
    others = F.array(*map(F.lit, OTHER_ENDS))
    apart = lambda t: F.when(F.exists(others, lambda x: F.contains(t, x)), F.split(t, rf"\r\n|[{LINE_END}]", -1)).otherwise(
        F.split(t, "\n", -1))
    last = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return let(let(c, apart), last)


def is_noise(line: Column) -> Column:
    """A passed test or a package manager's progress line."""
    passed = (line.contains(" PASSED") & line.rlike(rf"::[{WORD}]+ PASSED")) | (line.startswith("test ") & line.endswith(" ... ok"))
    return reduce(lambda acc, p: acc | line.startswith(p), fixed.NOISE_PREFIXES, passed)


def collapse_repeated_lines(df: DataFrame, text: str, out: str) -> DataFrame:
    """Drop noise lines and fold runs of equal lines; blank lines stay and do not end a run.

    The lines of a text are an array in its own row, so no shuffle is needed. ``pos`` leaves odd
    gaps: a run's marker goes right before the head of the next run, or to the end.
    """
    keep = ["*"]
    lines = df.select(*keep, split_lines(F.col(text)).alias("_l"))
    rows = F.transform(
        "_l",
        lambda x, i: F.struct(
            (i * 2).cast("int").alias("pos"), x.alias("line"), (~x.rlike(f"[^{WS}]")).alias("blank")
        ),
    )
    kept = lines.select(*keep, F.filter(rows, lambda r: r.blank | ~is_noise(r.line)).alias("_e"))
    split = kept.select(*keep, F.filter("_e", lambda r: ~r.blank).alias("_c"))
    ranked = F.transform(
        "_c",
        lambda c, j: F.struct(
            c.pos.alias("pos"),
            c.line.alias("line"),
            j.alias("nth"),
            (~c.line.eqNullSafe(F.get("_c", j - 1).line)).alias("head"),
        ),
    )
    heads = split.select(*keep, F.filter(ranked, lambda r: r.head).alias("_h"))
    end = F.lit(2**31 - 1)
    runs = F.transform(
        "_h",
        lambda h, m: F.struct(
            F.coalesce(F.get("_h", m + 1).pos - 1, end).alias("pos"),
            (F.coalesce(F.get("_h", m + 1).nth, F.size("_c")) - h.nth - 1).alias("more"),
        ),
    )
    marked = heads.select(*keep, F.filter(runs, lambda r: r.more > 0).alias("_m"))
    place = lambda r: F.struct(r.pos.alias("pos"), r.line.alias("line"))
    marker = lambda r: F.struct(
        r.pos.alias("pos"),
        F.concat(F.lit("... [repeated "), r.more.cast("string"), F.lit(" more times] ...")).alias("line"),
    )
    pieces = F.array_sort(
        F.concat(
            F.transform(F.filter("_e", lambda r: r.blank), place),
            F.transform("_h", place),
            F.transform("_m", marker),
        )
    )
    joined = F.array_join(F.transform(pieces, lambda r: r.line), "\n")
    return marked.withColumn(out, joined).drop("_l", "_e", "_c", "_h", "_m")


def compress_log_text(df: DataFrame, text: str, out: str) -> DataFrame:
    """Terminal noise away, then runs of equal lines folded."""
    return collapse_repeated_lines(df.withColumn("_t", strip_terminal(F.col(text))), "_t", out).drop("_t")


# ------------------------------------------------------------------------------- telegraphic style
def _drop_words(c: Column, words: list[str]) -> Column:
    return F.regexp_replace(c, whole_words(words), "")


def _polite(c: Column) -> Column:
    """Without pleasantries, one by one: each may uncover the next.

    A phrase is only looked for in texts that hold each of its words somewhere, which is a plain test. Letters that
    fold to plain ones in other ways than by lower case call for all phrases.
    """
    steps = F.array(*[
        F.struct(F.lit(whole_words([p]) + "[!,.:;?]*").alias("pattern"), F.array(*map(F.lit, p.split(" "))).alias("words"))
        for p in fixed.PLEASANTRIES
    ])
    there = lambda low: F.filter(steps, lambda s: F.forall(s.words, lambda w: F.contains(low, w)))
    some = F.element_at(F.transform(F.array(F.lower(c)), there), 1)  # lower case is worked out once
    steps = F.when(c.rlike("[ſ\u212aİı]"), steps).otherwise(some)
    return F.aggregate(steps, c, lambda acc, s: F.regexp_replace(acc, s.pattern, F.lit("")))


def telegraphic(c: Column, intensity: str = "full") -> Column:
    """Pleasantries away (lite), then articles and auxiliaries (full), then small words (ultra)."""
    c = F.when(c.rlike(whole_words(fixed.PLEASANTRIES)), _polite(c)).otherwise(c)
    c = strip(single_blanks(c))
    c = strip(F.ltrim(c, F.lit("!,.;? ")))
    if intensity == "lite":
        return strip(F.regexp_replace(c, "\n+", "\n"))
    # single words, removed without what is around them: one pass does for all lists
    more = fixed.PREPOSITIONS_PRONOUNS if intensity == "ultra" else []
    if intensity in ("full", "ultra"):
        c = _drop_words(c, fixed.ARTICLES + fixed.AUXILIARIES + more)
    c = single_blanks(c)
    for sign in "?.!,;":
        c = F.replace(c, F.lit(" " + sign), F.lit(sign))
    # whitespace with a line end in it is one line feed
    return F.array_join(F.filter(F.transform(split_lines(c), strip), lambda x: x != ""), "\n")
