"""History features at arrival: keyed state per path, event time, late rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from patchlake import rules
from patchlake.operators import features
from patchlake.operators.history import feature_columns
from patchlake.operators.models import Classifier

_STATE = "commits bigint, fixes bigint, plus bigint, minus bigint, last bigint, authors string, pending string"
_TOTALS = "path string, request_id string, us bigint, commits bigint, fixes bigint, plus bigint, minus bigint, authors bigint, last bigint"
_NAMES = [part.split(" ")[0] for part in _TOTALS.split(", ")]
_EVENT = ["us", "request_id", "changes", "fixes", "plus", "minus", "author"]


def _answer(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Events of a path wait until the watermark has passed them, then take effect in the order of their time.

    All requests of an instant are answered before the changes of that instant
    are added, so only strictly earlier changes count: the totals before an
    instant are running sums up to its first event. Work is one sort and a few
    passes over the columns, whatever the number of events at an instant.
    """
    *totals, last, authors, pending = state.get if state.exists else (0, 0, 0, 0, None, "[]", "[]")
    seen = set(json.loads(authors))
    waited = json.loads(pending)
    events = pd.concat([*([pd.DataFrame(waited, columns=_EVENT)] if waited else []), *(pdf[_EVENT] for pdf in pdfs)] or [pd.DataFrame(columns=_EVENT)])
    passed = state.getCurrentWatermarkMs() * 1000
    us = events["us"].to_numpy(dtype="int64")
    waiting = events[us >= passed]
    ready = events[us < passed].sort_values("us", kind="stable", ignore_index=True)
    answers = None
    if len(ready):
        us = ready["us"].to_numpy(dtype="int64")
        starts = np.flatnonzero(np.concatenate([[True], us[1:] != us[:-1]]))
        first = np.repeat(starts, np.diff([*starts, len(us)]))  # where the instant of each event begins
        changes = ready["changes"].fillna(0).to_numpy(dtype="int64")
        live = changes != 0
        # Only the first event of an author counts, and only if no earlier batch had it.
        named = ready.loc[live & ready["author"].notna().to_numpy(), "author"].drop_duplicates()
        named = named[~named.isin(seen)]
        new = np.zeros(len(us), dtype="int64")
        new[named.index] = 1
        sums = [changes, *(np.where(live, ready[c].fillna(0).to_numpy(dtype="int64"), 0) for c in ("fixes", "plus", "minus")), new]
        running = [np.concatenate([[start], start + np.cumsum(values)]) for start, values in zip([*totals, len(seen)], sums)]
        latest = np.concatenate([[-1], np.maximum.accumulate(np.where(live, np.arange(len(us)), -1))])
        before = latest[first]
        known = pd.Series(us[np.maximum(before, 0)], dtype="Int64").where(before >= 0, pd.NA if last is None else last)
        asked = ready["request_id"].notna().to_numpy()
        columns = [key[0], ready["request_id"], us, *(r[first] for r in running), known]
        answers = pd.DataFrame(dict(zip(_NAMES, columns)))[asked]
        *totals, _ = (int(r[-1]) for r in running)
        last = int(us[latest[-1]]) if latest[-1] >= 0 else last
        seen.update(named)
    kept = waiting.astype(object).where(waiting.notna(), None).values.tolist()
    state.update((*totals, last, json.dumps(sorted(seen)), json.dumps(kept)))
    if kept:
        state.setTimeoutTimestamp(max(min(e[0] for e in kept) // 1000, passed // 1000) + 1)
    if answers is not None and len(answers):
        yield answers


def history_at_arrival(events: DataFrame, delay: str) -> DataFrame:
    """(path, request_id, us, the nine history features) for every request of a stream.

    ``events`` has path, event_time, request_id (null for a change that asks
    nothing), changes (1 if the row is a change of the path, else 0), fixes, plus, minus
    and author. A row may be both. Rows may come up to ``delay`` after later ones
    and still count where they belong; a request is answered once the watermark
    has passed its time. Rows later than that are dropped and counted in the
    query's progress. State per path is the totals, the distinct authors and
    the rows within the delay; rows without path or time are left out.
    """
    timed = events.filter((F.col("path") != "") & F.col("event_time").isNotNull()).withColumn("us", F.unix_micros(F.col("event_time").cast("timestamp")))
    totals = (
        timed.withWatermark("event_time", delay)
        .groupBy("path")
        .applyInPandasWithState(_answer, _TOTALS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
    return totals.select("path", "request_id", "us", *feature_columns())


def score_at_arrival(answered: DataFrame, classifier: Classifier, threshold: float | None) -> DataFrame:
    """Answered requests, streamed or not, through a history-only classifier."""
    row = features.history_columns(answered.withColumn("historical_features", F.struct(*rules.HISTORY_FEATURES)), missing_days=0.0)
    return classifier.score(row, threshold).select("path", "request_id", "prediction", "probability_bug_fix")
