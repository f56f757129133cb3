"""Outcomes of a stream of operations, with the state of every key kept in the stream.

The batch job finds what an operation does by laying the stored records under the operations, which
reads the touched part of the table for every micro-batch. Here Spark's state store holds what each key was
left in: it is filled once, from a snapshot of the table, and a micro-batch reads its operations only.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedgate.operators.merge import KEY, base_states

#: The state store this needs; a session setting that holds for queries started while it is set.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

ACCEPTED = ("batch_id", "batch_seq", "ord", "op", "content_hash")
RESULT = T.StructType(
    [
        *(T.StructField(name, T.StringType()) for name in KEY),
        T.StructField("batch_id", T.StringType()),
        T.StructField("batch_seq", T.LongType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("op", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("outcome", T.StringType()),
    ]
)
_OUTCOME = Row(*RESULT.names)
_STATE = T.StructType([T.StructField("live", T.BooleanType()), T.StructField("content_hash", T.StringType())])


class KeyOutcomes(StatefulProcessor):
    """Keeps of a key whether its record is live, and the digest of its content."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._left = handle.getValueState("left", _STATE)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._left.update((initialState["op"] == "upsert", initialState["content_hash"]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # The operations of one key in one micro-batch; a stream limits its micro-batches, and so these.
        least = lambda value: (value is not None, value)
        ops = sorted(rows, key=lambda op: (op["batch_seq"], least(op["batch_id"]), least(op["ord"])))
        live, digest = self._left.get() or (False, None)
        for op in ops:
            content = op["content_hash"]
            if op["op"] == "delete":
                outcome = "tombstoned" if live else "unchanged"
                live, digest = False, None
            else:
                outcome = "unchanged" if live and content == digest else "stored"
                live, digest = True, content
            yield _OUTCOME(*key, *(op[name] for name in ACCEPTED), outcome)
        self._left.update((bool(live), digest))

    def close(self) -> None:
        pass


def stream_outcomes(accepted: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """The outcome of every accepted operation of a stream, in order of arrival.

    ``accepted`` has the key columns and ``batch_id, batch_seq, ord, op, content_hash``, as the batch
    operator takes them; operations of one micro-batch are ordered by batch and place. ``snapshot`` is the
    record table the stream starts from: it is read by the first micro-batch and never again, a restart
    goes on from the checkpoint. Set :data:`STORE` before the query is started.
    """
    ops = accepted.select(*KEY, *ACCEPTED).groupBy(*KEY)
    start = None if snapshot is None else base_states(snapshot).groupBy(*KEY)
    return ops.transformWithState(
        statefulProcessor=KeyOutcomes(), outputStructType=RESULT, outputMode="Append", timeMode="None", initialState=start
    )


def accepted_upserts(judged: DataFrame) -> DataFrame:
    """Judged operations that nothing is wrong with, as the outcome operators take them."""
    return judged.filter(F.col("code").isNull()).select(
        "source", "collection", F.col("record_id").alias("id"), "batch_id", "batch_seq", "ord", "op",
        F.when(F.col("op") == "upsert", F.col("content_hash")).alias("content_hash"),
    )
