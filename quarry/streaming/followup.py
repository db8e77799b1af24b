"""Follow-ups over a stream: a short user turn inherits the last full question of its conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.scratch import fresh_path

OUT = "conv_id long, turn long, resolved string"


def _turns(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    previous = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values("turn")
    out = []
    for turn, text in zip(rows["turn"], rows["text"], strict=True):
        whole = f"{previous} {text}" if len(text) < 60 and previous is not None else text
        out.append((key[0], turn, whole))
        previous = text
    if previous is not None:
        state.update((previous,))
    yield pd.DataFrame(out, columns=["conv_id", "turn", "resolved"])


def resolve(turns: DataFrame) -> DataFrame:
    """A streaming DataFrame of turns (conv_id, turn, role, text) to resolved user turns; state is one question a conversation."""
    users = turns.filter("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return users.groupBy("conv_id").applyInPandasWithState(_turns, OUT, "previous string", "append", GroupStateTimeout.NoTimeout)


def resolve_all(spark, path: str) -> DataFrame:
    """Drive the stream over what is at path and return all it gave; results go to files, not to memory."""
    base = fresh_path(spark, "stream")
    schema = "conv_id long, turn long, role string, text string"
    # a stream reads folders: one file is read as its folder, filtered by name
    parent, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    is_file = spark.read.parquet(path).inputFiles()[0].rstrip("/").endswith("/" + name)
    stream = source.option("pathGlobFilter", name).parquet(parent) if is_file else source.parquet(path)
    running = resolve(stream).writeStream.format("parquet").option("checkpointLocation", base + "/state").outputMode("append").trigger(availableNow=True).start(base + "/out")
    running.awaitTermination()
    return spark.read.schema(OUT).parquet(base + "/out")
