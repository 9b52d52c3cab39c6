"""Current labels from a live stream of actions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trackmill.operators.labels import valid_actions
from trackmill.streaming.state import need_rocks

FIELDS = ("label", "labeled_at", "source", "stars", "rated_at", "scorer", "assist")
ENTRY = "label string, labeled_at bigint, source string, stars bigint, rated_at bigint, scorer string, assist string"


def _none(v):
    return None if v is None or v != v else v


def apply_action(e: dict, a: dict) -> dict:
    """One valid action on one clip's entry (empty when there is none)."""
    kind, goal = a["action"], e.get("label") == "goal"
    if kind == "delete" or (kind == "label" and a["label"] is None):
        return {}
    if kind == "label":
        new = {"label": a["label"], "labeled_at": a["ts"]}
        if a["label"] == "goal":
            new.update({f: e.get(f) for f in ("stars", "scorer", "assist")})
        if a["stars"] is not None:
            new.update(stars=a["stars"], rated_at=a["ts"])
        if a["scorer"] is not None:
            new["scorer"] = a["scorer"]
        return new
    if kind == "bulk":
        return e or {"label": a["label"], "labeled_at": a["ts"], "source": a["source"]}
    if kind == "name_group":
        if not e:
            return {"label": "goal", "source": "ai", "scorer": a["scorer"]}
        return {**e, "scorer": a["scorer"]} if goal else e
    if not goal:
        return e
    if kind == "star":
        return {**e, "stars": a["stars"], "rated_at": a["ts"]}
    return {**e, kind: a[kind]}


class LabelFolder(StatefulProcessor):
    """Keeps one entry per clip and emits it after every batch that touched the clip."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        e = dict(zip(FIELDS, self.entry.get())) if self.entry.exists() else {}
        pdf = pd.concat(list(rows)).sort_values(["ts", "seq"])
        for a in pdf.to_dict("records"):
            e = apply_action(e, {k: _none(v) for k, v in a.items()})
        row = tuple(None if e.get(f) is None else int(e[f]) if f in ("labeled_at", "stars", "rated_at") else e[f] for f in FIELDS)
        if e:
            self.entry.update(row)
        else:
            self.entry.clear()
        yield pd.DataFrame([(key[0], *row)], columns=["clip", *FIELDS]).astype(
            {c: "Int64" for c in ("labeled_at", "stars", "rated_at")}
        )

    def close(self) -> None:
        pass


def stream_labels(actions: DataFrame) -> DataFrame:
    """Upserts (clip, entry…) per micro-batch; a null label means the entry is gone.

    Actions of a clip must arrive in order across batches; within one they are sorted.
    """
    need_rocks(actions.sparkSession)
    a = valid_actions(actions).select("clip", "ts", "ord.seq", "action", "label", "source", "stars", "scorer", "assist")
    return a.groupBy("clip").transformWithStateInPandas(
        statefulProcessor=LabelFolder(), outputStructType=f"clip bigint, {ENTRY}", outputMode="Update", timeMode="None"
    )
