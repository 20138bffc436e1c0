"""Triangle estimates over a streaming source of edges."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.reservoir import RESULT, Reservoir


def streaming_estimates(edges: DataFrame, size: int, improved: bool = False, replicas: int = 1, seed: int = 42) -> DataFrame:
    """A streaming DataFrame ``replica, seen, estimate`` over streaming ``edges(seq, u, v)``; write it in update mode.

    State per replica is one reservoir of ``size`` edges, whatever the stream's length.  Rows of a micro-batch come in any order, so each is
    put in order of ``seq``.  Repeated edges are seen again: dropping them would need memory without bound.
    """

    def play(key, frames, state):
        held = pickle.loads(state.get[0]) if state.exists else Reservoir(size, improved, seed=seed + int(key[0]))
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for u, v in zip(rows.u, rows.v):
            held.add(int(min(u, v)), int(max(u, v)))
        state.update((pickle.dumps(held),))
        yield pd.DataFrame([(key[0], held.seen, held.estimate())], columns=["replica", "seen", "estimate"])

    copies = edges.select("seq", "u", "v").where("u <> v").withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    return copies.groupBy("replica").applyInPandasWithState(play, RESULT, "held binary", "update", GroupStateTimeout.NoTimeout)


def stream_edge_files(spark, path: str) -> DataFrame:
    """Streaming ``seq, u, v`` from a folder of Parquet files."""
    return spark.readStream.schema("seq long, u long, v long").parquet(path)
