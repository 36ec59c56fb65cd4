"""Scores by a hosted classifier: one call for each text, a limit on calls in flight, retries
with back-off, errors that stop everything, and a gate that only complete scores pass.

Answers are written as they come in, so what comes after reads them and never asks again.
"""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import record_batch, slices, written


class FatalError(Exception):
    """An error that no further call would get past (credentials, a malformed request)."""


class IncompleteError(ValueError):
    """Not every text has a valid score of every theme."""


def one_call(ask: Callable[[str], Mapping[str, float]], text: str, tries: int, wait: float, longest: float) -> tuple[Mapping[str, float] | None, str | None, int]:
    """``(answer, error, calls)`` of asking for one text up to ``tries`` times.  The wait between
    two calls doubles up to ``longest`` seconds, less a random part, unless the error names
    one itself (``retry_after``).  A :class:`FatalError` is raised."""
    for call in range(1, tries + 1):
        try:
            return ask(text), None, call
        except FatalError:
            raise
        except Exception as e:
            if call == tries:
                return None, f"{type(e).__name__}: {e}", call
            own = getattr(e, "retry_after", None)
            time.sleep(min(longest, own if own is not None else wait * 2 ** (call - 1) * random.uniform(0.5, 1)))
    raise ValueError("tries must be positive")


def score_texts(texts: DataFrame, ask: Callable[[str], Mapping[str, float]], key: str, text: str, in_flight: int = 8, tasks: int | None = None, tries: int = 5, wait: float = 0.5, longest: float = 20.0) -> DataFrame:
    """``(key, tema, p, error, calls)``, written: the answers of ``ask`` for each different
    key, one call for each but for retries.  A text without an answer has one row with its error.

    ``tasks`` tasks (None: as the input is partitioned) have at most ``in_flight`` calls open
    at a time each.  A fatal error fails the job.  Rows with equal keys count once, by any
    of their texts; null keys are left out.  Calls of a task that is lost are made again.
    Texts are taken from a task's Arrow batches as they are asked for."""
    kind = dict(texts.dtypes)[key]
    once = texts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.any_value(text).alias(text))
    if tasks:
        once = once.repartition(tasks, key)

    def run(batches):
        with ThreadPoolExecutor(in_flight) as pool:
            waiting: deque = deque()

            def rows(down_to: int):
                while len(waiting) > down_to:
                    k, f = waiting.popleft()
                    got, error, calls = f.result()
                    if got is None:
                        yield k, None, None, error, calls
                    else:
                        yield from ((k, t, None if p is None else float(p), None, calls) for t, p in got.items())

            try:
                for part in slices(batches, text):
                    out, kinds = [], {key: part.schema.field(key).type, "tema": pa.string(), "p": pa.float64(), "error": pa.string(), "calls": pa.int32()}
                    for k, t in zip(part[key], part[text]):
                        waiting.append((k.as_py(), pool.submit(one_call, ask, t.as_py(), tries, wait, longest)))
                        out += rows(2 * in_flight)  # the pool holds the limit, this bounds what waits
                    yield record_batch(out, kinds)
                if waiting:
                    yield record_batch(rows(0), kinds)
            except FatalError:
                pool.shutdown(cancel_futures=True)
                raise

    return written(once.mapInArrow(run, f"`{key}` {kind}, tema string, p double, error string, calls int"), "answers")


def with_second_pass(texts: DataFrame, ask: Callable, key: str, text: str, in_flight: int = 8, slower: int = 2, **how) -> DataFrame:
    """Scores of all texts: those that failed are asked once more at the end, with fewer calls
    in flight.  Texts that have an answer aren't asked again."""
    first = score_texts(texts, ask, key, text, in_flight, **how)
    failed = texts.join(first.filter("error is not null").select(key), key, "left_semi")
    second = score_texts(failed, ask, key, text, slower, **how)
    return first.filter("error is null").unionByName(second)


def incomplete(texts: DataFrame, scores: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Keys of texts that lack a score between 0 and 1 of some theme, or have one of a theme
    that wasn't asked (empty: complete)."""
    valid = F.coalesce(F.col("p").between(0, 1) & F.col("tema").isin(*names), F.lit(False))
    good = scores.groupBy(key).agg(F.count_distinct("tema").alias("n"), F.bool_and(valid).alias("ok")).filter((F.col("n") == len(names)) & F.col("ok"))
    return texts.filter(F.col(key).isNotNull()).join(good, key, "left_anti").select(key).distinct()


def complete_or_stop(texts: DataFrame, scores: DataFrame, key: str, names: list[str], shown: int = 5) -> DataFrame:
    """``scores``, if they are complete; else :class:`IncompleteError` with the number of
    texts that aren't and the keys and errors of a few.  It runs at once."""
    left = incomplete(texts, scores, key, names)
    n = left.count()
    if n:
        errors = left.join(scores.filter("error is not null").groupBy(key).agg(F.first("error").alias("error")), key, "left").orderBy(key).limit(shown)
        raise IncompleteError(f"{n} texts without valid scores: " + ", ".join(f"{r[key]} ({r['error'] or 'missing or out of range'})" for r in errors.collect()))
    return scores.select(key, "tema", "p")
