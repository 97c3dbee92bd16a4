"""The monthly cycle as a stream: photos come in batches, and any cut into batches leaves the photos in the states of one run.

The sink of each batch is a folder named by its number and written over, so that a batch that is run again after a
failure leaves one copy; all other tables are derived from these rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators import month
from ..operators.decisions import Limits
from ..operators.lineage import cut
from ..operators.lookups import in_register, pick_last
from ..operators.photos import WAITING, meaningful
from ..operators.states import first_success, photo_state

#: The state store, and the columns of a result that decisions need.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "seq long, account string, photo_hash string, outcome string"


def new_files(spark: SparkSession, folder: str, schema: StructType | str, per_batch: int | None = None, kind: str = "parquet") -> DataFrame:
    """The rows of files that come into a folder, each file once; `per_batch` bounds the files of one batch."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(folder)


class FirstSuccess(StatefulProcessor):
    """Of an account's successes the first in the order of arrival, and within a batch of seq, stays; later ones are repeats."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.read = handle.getValueState("read", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        done = self.read.exists()
        decided = []
        for seq, outcome in zip(batch["seq"], batch["outcome"]):
            success = outcome in ("PLUS", "MINUS")
            decided.append("REPEAT" if success and done else outcome)
            if success and not done:
                done = True
                self.read.update((int(seq),))
        yield batch.assign(decided=decided)[["seq", "account", "photo_hash", "outcome", "decided"]]

    def close(self) -> None:
        pass


def first_success_stream(results: DataFrame) -> DataFrame:
    """results (RESULT) with decided: successes are keyed by account, and the state holds one number for each account of the month.

    All other results pass by the state: most of them have no account, and would be one group.
    """
    good = F.coalesce(F.col("outcome").isin("PLUS", "MINUS"), F.lit(False))
    keyed = results.where(good).groupBy("account").transformWithStateInPandas(FirstSuccess(), f"{RESULT}, decided string", "Append", "None")
    return keyed.unionByName(results.where(~good).withColumn("decided", F.col("outcome")))


def first_success_batch(results: DataFrame) -> DataFrame:
    """The same of a whole table."""
    return first_success(results.select("seq", "account", "photo_hash", "outcome"))


def distinct_contents(photos: DataFrame) -> DataFrame:
    """The first photo of each hash; photos without hash all stay. Without watermark, as the state lives for a month."""
    with_hash = photos.where("photo_hash <> ''").dropDuplicates(["photo_hash"])
    return with_hash.unionByName(photos.where("photo_hash = ''"))


def idempotent_sink(folder: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch to a partition of its own, over what a failed attempt left."""

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there now, in batches, then the end; the checkpoint makes the next run go on where this one stopped.

    State is kept in RocksDB, which the stateful operators need and which does not hold it in the heap; the session's own
    provider is in place again when the query has ended.
    """
    conf = stream.sparkSession.conf
    own = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(PROVIDER, own) if own else conf.unset(PROVIDER)
    return query


def reread(log: DataFrame, register: DataFrame, all_errors: bool = False) -> DataFrame:
    """(folder, name, serial): photos to read again: after a crash, with a serial that the register has by now, or all errors.

    Joined with the register anew in each batch, a photo whose serial was not found is read as soon as its row has come.
    """
    state = photo_state(log).where("state in ('error', 'waiting', 'not_in_db')")
    last = pick_last(meaningful(log), ["folder", "name"], F.desc("seq")).select("folder", "name", "serial", F.col("outcome").alias("last_outcome"))
    met = in_register(state.join(last, ["folder", "name"]), register, "serial")
    known = F.col("found") & (F.coalesce(F.trim("serial"), F.lit("")) != "")
    wanted = (F.col("state") == "error") | ((F.col("state") == "not_in_db") & known) | ((F.col("state") == "waiting") & (F.lit(all_errors) | ((F.col("last_outcome") == "SERIAL_NOT_FOUND") & known)))
    return met.where(wanted).select("folder", "name", "serial")


class CloseWaiting(StatefulProcessor):
    """Photos that wait for their account are closed by a REPEAT when a reading of it comes, be it before or after them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "photo_hash string", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for seq, account, photo, outcome in zip(batch["seq"], batch["account"], batch["photo_hash"], batch["outcome"]):
            if outcome in WAITING:
                self.waiting.updateValue((photo,), (int(seq),))
                continue
            if self.waiting.containsKey((photo,)):
                self.waiting.removeKey((photo,))
            if outcome in ("PLUS", "MINUS"):
                held = [(k[0], v[0]) for k, v in self.waiting.iterator()]
                out += [(v, account, k, "REPEAT") for k, v in held]
                for k, _ in held:
                    self.waiting.removeKey((k,))
        yield pd.DataFrame(out, columns=["seq", "account", "photo_hash", "outcome"]).astype({"seq": "int64"})

    def close(self) -> None:
        pass


def close_waiting_stream(results: DataFrame) -> DataFrame:
    """The REPEAT rows (seq of the closed row, account, photo_hash, outcome) that readings among results (RESULT) give.

    Results without account pass by the state: they wait for no reading, and would be one group.
    """
    return results.where("account <> ''").groupBy("account").transformWithStateInPandas(CloseWaiting(), RESULT, "Append", "None")


def run_month(spark: SparkSession, photos: str, schema: StructType, register: DataFrame | Callable[[int], DataFrame], log: DataFrame, folder: str, limits: Limits | None = None, reread: bool = False, per_batch: int | None = None) -> None:
    """Reads what has come into the folder `photos` since the last call; the month's rows (month.ROW) are in <folder>/log, in one part for each batch.

    A batch takes the new photos and those that are to be read again: after an ERROR, with a serial that the register has
    by now (it may be a function of the batch's number), and with reread all that wait. It sees the register and log as
    the batches before left them: accounts with a PLUS or MINUS have their reading, and photos that waited for it are
    closed. All of that is derived from the rows, so that one write is all that a batch does: it is whole or done again.

    However the photos are cut into batches in their order, every photo ends in the same state (month.final_states); one
    that fails again and again has an ERROR of each batch. A batch reads the keys and outcomes of the rows before it, and
    of earlier photos only those that it reads again.
    """
    base = log.agg(F.max("seq")).first()[0] or 0

    def decide(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = register(number) if callable(register) else register
        seen = log
        if number:
            before = session.read.schema(f"{month.ROW}, batch int").parquet(f"{folder}/log").where(F.col("batch") < number)
            seen = log.unionByName(before.select("seq", "photo", "name", "photo_hash", "serial", "account", "outcome", "source", "notes"), allowMissingColumns=True)
            known = month.filled_register(known, before)
            keys = cut(month.to_read_again(seen, known, reread))
            if not keys.isEmpty():
                earlier = session.read.schema(schema).option("recursiveFileLookup", True).parquet(photos).withColumn("key", month.photo_key())
                batch = batch.unionByName(earlier.join(keys, "key", "left_semi").drop("key")).dropDuplicates(["photo"])
        month.run_rows(batch, known, seen, limits, reread, number, base).write.mode("overwrite").parquet(f"{folder}/log/batch={number}")

    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    stream = (stream.option("maxFilesPerTrigger", per_batch) if per_batch else stream).parquet(photos)
    run_available(stream, decide, f"{folder}/state")


def month_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The log rows of all batches of a month."""
    return spark.read.schema(f"{month.ROW}, batch int").parquet(f"{folder}/log")
