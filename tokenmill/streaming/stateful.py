"""Streams with a state for each key: rate flags, alert silence, running budgets, remembered labels, provider events.

All of them use Spark's keyed state, so a micro-batch reads and writes the state of its own keys alone. A task
gets a key's rows of one micro-batch and keeps a few numbers of each; the source's limit of files or
entries for a micro-batch bounds them. Nothing is dropped for being late: rows are taken as they
arrive, and inside a micro-batch by time and number.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tokenmill.functions import fixed
from tokenmill.functions.scalars import finish_reason
from tokenmill.functions.text import normalise_prompt, prompt_key, token_estimate
from tokenmill.operators.meter import spend
from tokenmill.operators.ordered import micros

# the state functions travel to the workers themselves, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
KEEP_SECONDS = 3600  # rate windows of a key that are kept behind its newest request


def _columns(batches: Iterator[pd.DataFrame], columns: list[str]) -> list[np.ndarray]:
    """A key's columns of the micro-batch. Keys have few rows each, so the work per key is plain arrays, not tables."""
    parts = [[b[c].to_numpy() for c in columns] for b in batches]
    return parts[0] if len(parts) == 1 else [np.concatenate(p) for p in zip(*parts)]


def _in_order(batches: Iterator[pd.DataFrame], columns: list[str]) -> dict[str, np.ndarray]:
    """A key's rows of the micro-batch by time and number, as columns."""
    rows = dict(zip(columns, _columns(batches, columns)))
    order = np.lexsort((rows["id"], rows["t"]))
    return {c: v[order] for c, v in rows.items()}


def _fires(t: np.ndarray, silence: int, last: int | None) -> tuple[list[int], int | None]:
    """Places of the rows that fire, of ascending times, and the last time that did. Rows before the end of a silence that
    has begun are silent, also late ones."""
    fired, at = [], 0 if last is None else int(np.searchsorted(t, last + silence))
    while at < len(t):
        fired.append(at)
        last = int(t[at])
        at = int(np.searchsorted(t, last + silence))
    return fired, last


def rate_flags_stream(
    requests: DataFrame, key: str, ts: str = "ts", row_id: str = "request_id", limit: int = fixed.RATE_LIMIT,
    width: int = fixed.RATE_WINDOW_SECONDS, keep: int = KEEP_SECONDS,
) -> DataFrame:
    """(key, row_id, nth, limited) for every request: its number in the key's clock window, and whether that is over the limit.

    A late request is counted in its own window, behind those that came before it. The state of a key has its
    windows of the last ``keep`` seconds before its newest request; a request that is later still opens its window anew.
    """
    wide = width * 1_000_000

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = {int(w): n for w, n in json.loads(state.get[0]).items()} if state.exists else {}
        rows = _in_order(batches, ["t", "id"])
        windows, begin, sizes = np.unique(rows["t"] // wide, return_index=True, return_counts=True)  # times ascend, and so do windows
        before = np.array([counts.get(w, 0) for w in windows.tolist()], dtype=np.int64)
        nth = np.arange(len(rows["t"])) + np.repeat(before + 1 - begin, sizes)
        for w, n, b in zip(windows.tolist(), sizes.tolist(), before.tolist()):
            counts[w] = b + n
        oldest = max(counts) - keep // width
        state.update((json.dumps({w: n for w, n in counts.items() if w >= oldest}),))
        yield pd.DataFrame({"key": k[0], "id": rows["id"], "nth": nth, "limited": nth > limit})

    rows = requests.select(F.col(key).cast("string").alias("key"), micros(F.col(ts)).alias("t"), F.col(row_id).cast("bigint").alias("id"))
    flags = rows.groupBy("key").applyInPandasWithState(
        run, "key string, id bigint, nth bigint, limited boolean", "counts string", "append", GroupStateTimeout.NoTimeout)
    return flags.select(F.col("key").alias(key), F.col("id").alias(row_id), "nth", "limited")


def alert_silence_stream(
    events: DataFrame, key: str, ts: str = "ts", row_id: str = "id", silence: int = fixed.ALERT_SILENCE_SECONDS
) -> DataFrame:
    """(key, t, id) of events that fire: none for ``silence`` seconds after one of the same key fired. The state is a number a key."""
    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _in_order(batches, ["t", "id"])
        fired, last = _fires(rows["t"], silence * 1_000_000, state.get[0] if state.exists else None)
        if fired:
            state.update((last,))
        yield pd.DataFrame({"key": k[0], "t": rows["t"][fired], "id": rows["id"][fired]})

    rows = events.select(F.col(key).cast("string").alias("key"), micros(F.col(ts)).alias("t"), F.col(row_id).cast("bigint").alias("id"))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, t bigint, id bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def budget_stream(
    charges: DataFrame, keys: DataFrame, ts: str = "ts", row_id: str = "request_id", cost: str = "cost_usd",
    silence: int = fixed.ALERT_SILENCE_SECONDS, tz: str = "UTC", share: float = fixed.LOW_BUDGET_SHARE,
) -> DataFrame:
    """Balance before and after each charge, refusals, and low-budget alerts with their silence.

    The state of a key has what it spent, in trillionths, and when its last alert fired; for monthly keys what it
    spent by month, so that each month starts anew and a late charge meets its own month. Charges of unknown
    keys come out as refused, with a balance of zero, as in batch.
    """
    one, part = 10**12, Decimal(str(share))

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, last = state.get if state.exists else ("{}", None)
        spent = json.loads(text)
        rows = _in_order(batches, ["t", "id", "month", "spend", "total"])
        charges, months = rows["spend"].tolist(), rows["month"].tolist()
        before = []
        for month, s in zip(months, charges):
            before.append(spent.get(month, 0))
            spent[month] = before[-1] + s
        total = rows["total"][0]
        budget = int(total) * 10**8 if total == total and total is not None else None
        left = [max(budget - b, 0) if budget is not None else 0 for b in before]
        after = [max(budget - b - s, 0) if budget is not None else 0 for b, s in zip(before, charges)]
        low = [budget is not None and budget > 0 and s > 0 and a < budget * part for a, s in zip(after, charges)]
        at = np.flatnonzero(low)
        fired, last = _fires(rows["t"][at], silence * 1_000_000, last)
        alert = np.zeros(len(before), bool)
        alert[at[fired]] = True
        state.update((json.dumps(spent), last))
        yield pd.DataFrame({
            "api_key_id": k[0], "request_id": rows["id"], "balance_before": [Decimal(x).scaleb(-12) for x in left],
            "balance_after": [Decimal(x).scaleb(-12) for x in after], "refused": [x <= 0 for x in left], "alert": alert,
        })

    named = keys.select(F.col("id").cast("string").alias("key"), (F.col("total_budget") * 10_000).cast("bigint").alias("total"), "budget_type")
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz)
    rows = charges.select(
        F.col("api_key_id").alias("key"), micros(F.col(ts)).alias("t"), F.col(row_id).cast("bigint").alias("id"),
        F.date_format(local, "yyyy-MM").alias("in_month"), (spend(F.col(cost), "exact") * F.lit(one)).cast("bigint").alias("spend"),
    ).join(named, "key", "left")
    month = F.when(F.col("budget_type") == "monthly", F.col("in_month")).otherwise("")
    schema = "api_key_id string, request_id bigint, balance_before decimal(38,12), balance_after decimal(38,12), refused boolean, alert boolean"
    return rows.select("key", "t", "id", month.alias("month"), "spend", "total").groupBy("key").applyInPandasWithState(
        run, schema, "spent string, last bigint", "append", GroupStateTimeout.NoTimeout)


def memo_label_stream(
    requests: DataFrame, label: Callable[[str], str], text: str = "text", ts: str = "ts", row_id: str = "request_id",
    ttl: int = fixed.MEMO_SECONDS, keep: int | None = None,
) -> DataFrame:
    """(row_id, intent, remembered): each text is labelled once, and its copies get that label for ``ttl`` seconds.

    Texts are equal when they are equal after ``normalise_prompt``. ``label`` runs in the executors, once for each text
    and ttl; load a model lazily in there. A label serves for ``ttl`` seconds of event time from the request that asked for it;
    serving does not prolong it, and a late request is served too. With ``keep``, the state of a text that no request asks for
    is forgotten after that many milliseconds of the clock; that needs a stream that runs on, as Spark never ends
    a drained one while it waits for such a time. Only the first row of a text is kept in a task.
    """
    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        intent, last = state.get if state.exists else (None, None)
        first, parts = None, []
        for b in batches:
            if first is None and len(b):
                first = b["text"].iloc[0]
            parts.append(b[["t", "id"]])
        rows = _in_order(iter(parts), ["t", "id"])
        fired, last = _fires(rows["t"], ttl * 1_000_000, last)
        asked = np.zeros(len(rows["t"]), bool)
        asked[fired] = True
        if fired:
            intent = label(first)
            state.update((intent, last))
        if keep is not None:
            state.setTimeoutDuration(keep)
        yield pd.DataFrame({"id": rows["id"], "intent": intent, "remembered": ~asked})

    clean = normalise_prompt(F.coalesce(F.col(text), F.lit("")))
    rows = requests.select(prompt_key(clean).alias("key"), micros(F.col(ts)).alias("t"), F.col(row_id).cast("bigint").alias("id"), clean.alias("text"))
    out = rows.groupBy("key").applyInPandasWithState(
        run, "id bigint, intent string, remembered boolean", "intent string, last bigint", "append",
        GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.ProcessingTimeTimeout)
    return out.select(F.col("id").alias(row_id), "intent", "remembered")


def stream_fold_stateful(events: DataFrame, ts: str = "ts", patience_ms: int = 600_000, lateness: str = "1 minute") -> DataFrame:
    """Provider events (msg_id, seq, ts, type, message, delta, usage) folded as they arrive.

    A message comes out at its stop event, or unfinished when nothing arrived for ``patience_ms``.
    """
    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        given, made, text, reason = state.get if state.exists else (0, 0, "", "")
        finished, seen = False, 0
        if not state.hasTimedOut:
            fields = ["seq", "t", "type", "given", "made", "text", "reason"]
            columns = _columns(batches, fields)
            seen, pieces = max(0, int(columns[1].max() // 1000)), [text]
            order = np.argsort(columns[0], kind="stable")
            for kind, g, m, piece, why in zip(*(c[order].tolist() for c in columns[2:])):
                if kind == "message_start":
                    given = int(g) if g is not None and g == g else 0
                elif kind == "content_block_delta":
                    pieces.append(piece or "")
                elif kind == "message_delta":
                    made = int(m) if m is not None and m == m else made
                    reason = why or reason
                elif kind == "message_stop":
                    finished = True
            text = "".join(pieces)
        if finished or state.hasTimedOut:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(k[0], given, made, text, reason or None, finished)],
                               columns=["msg_id", "given", "made", "text", "reason", "finished"])
        else:
            state.update((given, made, text, reason))
            state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + patience_ms)

    rows = events.withWatermark(ts, lateness).select(
        "msg_id", "seq", micros(F.col(ts)).alias("t"), "type",
        F.col("message.usage.input_tokens").cast("double").alias("given"),
        F.col("usage.output_tokens").cast("double").alias("made"),
        F.col("delta.text").alias("text"), F.col("delta.stop_reason").alias("reason"), F.col(ts).alias("ts"),
    )
    folded = rows.groupBy("msg_id").applyInPandasWithState(
        run, "msg_id bigint, given bigint, made bigint, text string, reason string, finished boolean",
        "given bigint, made bigint, text string, reason string", "append", GroupStateTimeout.EventTimeTimeout,
    )
    return folded.select(
        "msg_id", F.when(F.col("given") > 0, F.col("given")).otherwise(token_estimate(F.lit(""))).alias("prompt_tokens"),
        F.when(F.col("made") > 0, F.col("made")).otherwise(token_estimate(F.col("text"))).alias("completion_tokens"),
        "text", finish_reason(F.col("reason")).alias("finish_reason"), "finished",
    )
