"""Filling fixed-capacity containers with texts, by hierarchical best-fit packing."""

from __future__ import annotations

import base64
import bisect

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, narrow_batches

#: Folder and file of the public tokenizer; both are parameters of the operator.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how that tokenizer parts a text before it looks up its vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP_ITEMS = 20_000
NEARLY_FULL = 0.99
#: Rounds end once one has spared less than this part of the bins that it was given.
LEAST_GAIN = 0.001
_encodings: dict[tuple[str, str], object] = {}


def _encoding(path: str, pattern: str = PATTERN):
    """The tokenizer of this Python worker, built once."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens`` of each document; null and empty texts have none, repeated rows count once."""
    path = f"{tokenizers}/{vocabulary}"

    def run(batches):
        enc = _encoding(path, pattern)
        for t in narrow_batches(batches, 1024, "text"):
            n = [len(enc.encode_ordinary(x)) if x else 0 for x in t.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    return docs.mapInArrow(run, "doc_id long, n_tokens long").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers, each item into the fullest bin that takes it."""
    bins: list[list[int]] = []
    open_by: dict[int, list[int]] = {}
    residuals: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        s = sizes[i]
        at = bisect.bisect_left(residuals, s)
        if at < len(residuals):
            r = residuals[at]
            b = open_by[r].pop()
            if not open_by[r]:
                del open_by[r]
                residuals.pop(at)
            bins[b].append(i)
            r -= s
        else:
            b = len(bins)
            bins.append([i])
            r = capacity - s
        if r > 0:
            if r not in open_by:
                open_by[r] = []
                bisect.insort(residuals, r)
            open_by[r].append(b)
    return bins


BIN = "container_kind long, capacity int, given int, bin string, fill int, docs array<long>, pieces array<int>, sizes array<int>, done boolean"


def _packer(rnd: int):
    """Pack the items or underfull bins of one group; nearly full bins are done.

    ``given`` is the number of items that the group had, in the row of its first bin.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, capacity, grp = (int(k) for k in key)
        pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        fill, docs, pieces, sizes = (pdf[c].tolist() for c in ("fill", "docs", "pieces", "sizes"))
        rows = []
        for k, members in enumerate(best_fit(fill, capacity)):
            total = sum(fill[m] for m in members)
            cells = ([x for m in members for x in col[m]] for col in (docs, pieces, sizes))
            rows.append((kind, capacity, 0 if k else len(fill), f"{rnd}-{grp}-{k}", total, *cells, total >= NEARLY_FULL * capacity))
        return pd.DataFrame(rows, columns=["container_kind", "capacity", "given", "bin", "fill", "docs", "pieces", "sizes", "done"])

    return run


def pack(sizes: DataFrame, kinds: list[tuple[int, int]]) -> DataFrame:
    """``container_kind, container_id, doc_id, piece, n_tokens``: each item in a container of each kind.

    ``sizes`` has ``doc_id, n_tokens``; ``kinds`` lists (container_kind, capacity). An item is
    split only if it alone exceeds the capacity: into full pieces, which fill containers of
    their own, and a remainder that is packed like an item. Round 0 packs groups of about
    GROUP_ITEMS items by best fit and emits nearly full bins. Each later round deals the
    underfull bins to as many groups as hold GROUP_ITEMS of them and packs them as items; no
    group outgrows that number, however few bins got full. The rounds end when the bins of a
    kind fit in one group and have been packed there, or when a round has spared hardly any:
    then the rest cannot be put together, and all bins are emitted. An item without tokens
    needs no container: its row has a null ``container_id``. Empty input gives no rows.
    """
    sizes = cut(sizes.where(F.col("n_tokens") >= 0))
    n = sizes.count()
    groups = max(1, -(-n // GROUP_ITEMS))
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("container_kind"), F.lit(c).cast("int").alias("capacity")) for k, c in kinds]))
    items = sizes.select("doc_id", "n_tokens", each.alias("k")).select("k.*", "doc_id", "n_tokens")
    empty = items.where(F.col("n_tokens") == 0).select("container_kind", F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"))
    full = F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(0).cast("int")
    items = items.where(F.col("n_tokens") > 0).withColumn("full", full)
    whole = items.where(F.col("full") > 0).select("container_kind", "doc_id", F.explode(F.expr("sequence(0, full - 1)")).alias("piece"), F.col("capacity").alias("n_tokens"))
    whole = whole.select("container_kind", F.format_string("full-%d-%d", "doc_id", "piece").alias("container_id"), "doc_id", "piece", "n_tokens")
    rest = (F.col("n_tokens") - F.col("full").cast("long") * F.col("capacity")).cast("int")
    bins = items.withColumn("rest", rest).where(F.col("rest") > 0)
    bins = bins.select(
        "container_kind", "capacity", F.format_string("%020d", "doc_id").alias("bin"), F.col("rest").alias("fill"),
        F.array("doc_id").alias("docs"), F.array("full").alias("pieces"), F.array("rest").alias("sizes"),
    )
    out, rnd, left = [], 0, {k: n for k, _ in kinds}
    while left:
        groups = {k: max(1, -(-m // GROUP_ITEMS)) for k, m in left.items()}
        width = F.element_at(F.create_map(*[F.lit(x).cast("long") for kg in groups.items() for x in kg]), F.col("container_kind"))
        dealt = bins.where(F.col("container_kind").isin(list(left))).withColumn("grp", F.pmod(F.xxhash64("bin", F.lit(rnd)), width))
        packed = cut(dealt.groupBy("container_kind", "capacity", "grp").applyInPandas(_packer(rnd), BIN))
        tally = packed.groupBy("container_kind").agg(F.sum("given").alias("given"), F.count(F.lit(1)).alias("made"), F.count_if(~F.col("done")).alias("open"))
        # one row per kind
        left = {r["container_kind"]: r["open"] for r in tally.collect() if groups[r["container_kind"]] > 1 and r["open"] > 1 and r["given"] - r["made"] > LEAST_GAIN * r["given"]}
        again = F.col("container_kind").isin(list(left)) & ~F.col("done") if left else F.lit(False)
        out.append(packed.where(~again))
        bins, rnd = packed.where(again).drop("given", "done"), rnd + 1
    rows = whole.unionByName(empty)
    for done in out:
        cells = done.select("container_kind", F.col("bin").alias("container_id"), F.explode(F.arrays_zip("docs", "pieces", "sizes")).alias("c"))
        rows = rows.unionByName(cells.select("container_kind", "container_id", F.col("c.docs").alias("doc_id"), F.col("c.pieces").alias("piece"), F.col("c.sizes").alias("n_tokens")))
    return rows


def container_kinds(containers: DataFrame, most: int = 1000) -> list[tuple[int, int]]:
    """The capacities to pack for; refused beyond ``most`` rows, since each is a pass over the items."""
    rows = containers.select("container_kind", "capacity_tokens").where("capacity_tokens > 0").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} container kinds")
    return sorted((r[0], r[1]) for r in rows)


def usage(packed: DataFrame, kinds: list[tuple[int, int]]) -> DataFrame:
    """Per kind: containers, tokens, and the used part of the space in parts per million."""
    capacity = F.create_map(*[F.lit(x) for k, c in kinds for x in (k, c)])
    per = packed.where("container_id is not null").groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").cast("long").alias("tokens"))
    return per.withColumn("used_ppm", F.floor(F.col("tokens") * 1000000 / (F.col("containers") * capacity[F.col("container_kind")])))
