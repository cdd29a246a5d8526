"""Set-at-a-time Spark jobs over LLM traffic: requests, token logs, keys, rules, prices, answers."""
