"""get the JSON value out of a model's reply text.

Well-formed replies (a fenced block or a plain object, the bulk) are cut and
checked by native expressions. Only the rest goes to Python in Arrow
batches, where the position of the parse error decides how to repair it.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.documents import is_strict_json

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Known misprint, slips that are tidied in a fenced reply, fence patterns, and the endings that close a cut document.
MISPRINT = ('""sublocation_2"', '"sublocation_2"')
SLIPS = ((",]", "]"), (",}", "}"), ('""', '"'))
CLOSED_FENCE = r"```(?:json)?\s*([\s\S]*?)\s*```"
OPEN_FENCE = r"```(?:json)?\s*([\s\S]*)$"
AFTER_ENTRY = "]}]}"
AFTER_BRACE = ("]}", "]}]", "]}]}")

RESULT = "json string, recovered boolean, tier string"


def _braces(text: Column) -> Column:
    """From the first { to the last }; '' without both."""
    return F.regexp_extract(text, r"\{[\s\S]*\}", 0)


def _cut(text: str) -> str | None:
    start, end = text.find("{"), text.rfind("}")
    return text[start : end + 1] if start >= 0 and end >= 0 else None


def _closed(text: str, error_at: int) -> Iterator[str]:
    """Possible documents that end with the last complete object before the error."""
    intact = text[:error_at]
    entry = intact.rfind("},")
    if entry >= 0:
        yield intact[: entry + 1] + AFTER_ENTRY
    brace = intact.rfind("}")
    if brace >= 0:
        for ending in AFTER_BRACE:
            yield intact[: brace + 1] + ending


def _readings(content: str) -> Iterator[tuple[str, str]]:
    """(tier, text) in the order in which they are to be trusted."""
    fence = re.search(CLOSED_FENCE, content) or re.search(OPEN_FENCE, content)
    body = _cut(fence.group(1).strip()) if fence else None
    if body is not None:
        yield "fence", body
    plain = _cut(content)
    if plain:
        yield "object", plain
    yield "raw", content


def _parse(text: str):
    try:
        return True, json.loads(text), -1
    except json.JSONDecodeError as error:
        return False, None, error.pos
    except RecursionError:
        return False, None, 0


def salvage(content: str) -> tuple[str | None, bool, str | None]:
    """(JSON text, whether data was cut off, tier) of one reply; empty values count as nothing."""
    content = content.replace(*MISPRINT)
    for tier, text in _readings(content):
        ok, value, error_at = _parse(text)
        recovered = False
        if not ok and tier == "fence":
            tidy = text
            for slip in SLIPS:
                tidy = tidy.replace(*slip)
            ok, value, _ = _parse(tidy)
            tier = "fence_tidied" if ok else tier
        if not ok and tier != "raw":
            for candidate in _closed(text, error_at):
                ok, value, _ = _parse(candidate)
                if ok:
                    recovered, tier = True, f"{tier}_closed"
                    break
        if ok:
            return (json.dumps(value, ensure_ascii=False) if value else None), recovered, tier
    return None, False, None


def _repaired(content: Column) -> Column:
    @F.pandas_udf(RESULT)
    def batch(contents: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if c is None else salvage(c) for c in contents]
        return pd.DataFrame(rows, columns=["json", "recovered", "tier"])

    # not to be moved or repeated by the optimizer
    return batch.asNondeterministic()(content)


def extract_json(df: DataFrame, content: str, name: str = "reply") -> DataFrame:
    """Add struct column ``name`` (json, recovered, tier) for the reply text in ``content``.

    Each step is a column of its own, so no step is evaluated twice.
    """
    text, fenced, body, reading = (F.col(c) for c in ("_text", "_fenced", "_body", "_reading"))
    steps = df.withColumn("_text", F.replace(F.col(content), F.lit(MISPRINT[0]), F.lit(MISPRINT[1])))
    closed = F.regexp_extract(text, CLOSED_FENCE, 1)
    steps = steps.withColumn(
        "_fenced",
        F.when(text.contains("```"), F.when(text.rlike("```[\\s\\S]*```"), closed).otherwise(F.regexp_extract(text, OPEN_FENCE, 1))),
    )
    steps = steps.withColumn("_body", F.coalesce(_braces(fenced), F.lit("")))
    steps = steps.withColumn("_reading", F.when(body != "", body).otherwise(_braces(text)))
    # a } before the first { inside a fence is a case for the repair tiers
    crossed = (body == "") & fenced.contains("{") & fenced.contains("}")
    usable = (reading != "") & ~reading.rlike(r"^\{\s*\}$") & ~F.coalesce(crossed, F.lit(False))
    steps = steps.withColumn("_strict", F.when(usable, is_strict_json(reading)).otherwise(False))
    strict = F.col("_strict")
    steps = steps.withColumn("_hard", _repaired(F.when(~strict, F.col(content))))
    easy = F.struct(
        reading.alias("json"), F.lit(False).alias("recovered"), F.when(body != "", "fence").otherwise("object").alias("tier")
    )
    return steps.withColumn(name, F.when(strict, easy).otherwise(F.col("_hard"))).drop(
        "_text", "_fenced", "_body", "_reading", "_strict", "_hard"
    )
