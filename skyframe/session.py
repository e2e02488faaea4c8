"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; Catalyst prunes its columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent (tests on one machine) a temporary folder is set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="skyframe-checkpoint-")
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Survives the loss of executors, unlike cached blocks or a local checkpoint.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it from there.

    Cuts lineage like :func:`cut`, but in compressed columns, of which later plans read only
    those that they need.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """Configured number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def narrow_batches(batches, rows: int, text: str | None = None, most_bytes: int = 4_000_000):
    """The Arrow batches of a partition as tables of about ``rows`` rows.

    Small batches are put together and large ones cut; with ``text`` a table also ends once that
    column has ``most_bytes``, so that long texts do not add up. A single row is never cut.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    held, n = [], 0
    for b in batches:
        at = 0
        if text is not None and b.num_rows:
            size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
        while at < b.num_rows:
            step = rows - n
            if text is not None:
                before = size[at - 1] if at else 0
                step = min(step, max(1, int((size - before).searchsorted(most_bytes, side="right")) - at))
            part = b.slice(at, step)
            at += part.num_rows
            held.append(part)
            n += part.num_rows
            if n >= rows or (text is not None and at < b.num_rows):
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches, keys: list[str], rows: int):
    """Tables of whole groups of about ``rows`` rows, and where each group starts.

    The rows of a group must follow one another, as they do behind a window over ``keys`` or in a
    sorted partition. A table has more rows only where one group has; null is a key like any other.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def starts(t):
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            c = t.column(k).combine_chunks()
            a, b = c.slice(1), c.slice(0, max(0, len(c) - 1))
            differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(a.is_null(), b.is_null()))
            new[1:] |= differ.to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    held = None
    for t in narrow_batches(batches, rows):
        held = t if held is None else pa.concat_tables([held, t])
        first = starts(held)
        if held.num_rows and len(first) > 1:
            yield held.slice(0, first[-1]), first[:-1]
            held = held.slice(first[-1])
    if held is not None and held.num_rows:
        yield held, starts(held)
