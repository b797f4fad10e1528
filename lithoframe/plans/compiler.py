"""Views and queries as SQL text for Spark, and the same text for the checking engine.

A query names views and base tables; compile() puts the views it needs, and no others, in front of it as
common table expressions, so each query is one declarative plan that Catalyst prunes and pushes down as a
whole. Three notations differ between the engines and are written as macros: `a DIV b` on non-negative
integers, `@floor(a, b)` for exact floor division by a positive b, and `@series(t, i, n)` for the rows
i = 0 .. n - 1.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> str:
    VIEWS[name] = sql
    return name


def _args(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of a call whose bracket opens at `at`, and the place after it."""
    out, depth, start = [], 0, at + 1
    for i in range(at, len(text)):
        c = text[i]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return [*out, text[start:i].strip()], i + 1
        elif c == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
    raise ValueError("a bracket is not closed: " + text[at : at + 60])


def _expanded(text: str, spark: bool) -> str:
    while (m := re.search(r"@(floor|series)\(", text)) is not None:
        args, end = _args(text, m.end() - 1)
        if m[1] == "floor":
            a, b = args
            new = f"(({a}) - pmod(({a}), ({b}))) DIV ({b})" if spark else f"(({a}) - ((({a}) % ({b})) + ({b})) % ({b})) // ({b})"
            new = f"({new})"
        else:
            t, i, n = args
            new = f"LATERAL explode(sequence(CAST(0 AS BIGINT), CAST({n} AS BIGINT) - 1)) {t}({i})" if spark else f"LATERAL (SELECT unnest(range(CAST({n} AS BIGINT))) AS {i}) {t}"
        text = text[: m.start()] + new + text[end:]
    return text


def _dialect(text: str, spark: bool, sf_dir: str) -> str:
    text = _expanded(text, spark)
    if spark:
        return re.sub(r"(?i)\b(from|join)\s+(" + "|".join(BASE) + r")\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet` {m[2]}" if not _aliased(text, m.end()) else f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", text)
    text = re.sub(r"\bDIV\b", "//", text)
    return re.sub(r"\bAS STRING\b", "AS VARCHAR", text)


def _aliased(text: str, end: int) -> bool:
    m = re.match(r"\s+(?:AS\s+)?([A-Za-z_]\w*)", text[end:])
    return bool(m) and m[1].lower() not in ("where", "group", "order", "join", "left", "on", "union", "limit", "lateral", "having", "cross", "inner")


def _needed(text: str, done: list[str]) -> None:
    for name in sorted({m for m in re.findall(r"\b[a-z_]\w*\b", text) if m in VIEWS}):
        if name not in done:
            _needed(VIEWS[name], done)
            if name not in done:
                done.append(name)


def compiled(text: str, spark: bool, sf_dir: str = "") -> str:
    order: list[str] = []
    _needed(text, order)
    parts = [f"{n} AS ({_dialect(VIEWS[n], spark, sf_dir)})" for n in order]
    body = _dialect(text, spark, sf_dir).strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(compiled(text, True, sf_dir))


def oracle(text: str) -> str:
    return compiled(text, False)
