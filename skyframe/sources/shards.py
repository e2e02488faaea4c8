"""Raw catalogue shards: rejected rows with reasons, schema drift, one consistent table.

The lines are read once. Each row becomes a *fact*: a pattern with one symbol per value (missing,
text, whole or other number, possible as right ascension or declination), and for files whose
names changed the values that renames are found by. Rejects, types, schema versions and
migration steps are derived from the facts and from one small row per file.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, narrow_batches, stored
from . import delimited as dl

SALTS = 16
#: Shards whose rules (numbers of columns, at most a few hundred bytes each) may be sent to all tasks.
FEW_SHARDS = 50_000
CHUNK_ROWS = 50_000
#: A value of at least this many digits or letters can tell a source from the others.
TELLING = 6
#: Values by which a row is linked with the other file: those with the smallest hashes of the telling ones.
LINKS = 3
#: Types from narrow to wide.
TYPES = ["integer", "decimal", "text"]


# ---- lines and headers -------------------------------------------------------------------


def carrying(raw: DataFrame) -> DataFrame:
    """Lines that carry a header or a row: null, blank and ``#`` lines are dropped."""
    line = F.col("line")
    return raw.where(line.isNotNull() & ~line.startswith("#") & line.rlike(r"\S"))


def _names(batches):
    for pdf in batches:
        yield pd.DataFrame({"shard_id": pdf.shard_id, "header_id": pdf.header_id, "names": [dl.header_names(x) for x in pdf.line]})


def headers(raw: DataFrame) -> DataFrame:
    """``shard_id, header_id, names``: the first line of each shard that carries anything."""
    first = (
        carrying(raw)
        .groupBy("shard_id")
        .agg(F.min(F.struct("line_no", "raw_id", "line")).alias("h"))
        .select("shard_id", F.col("h.raw_id").alias("header_id"), F.col("h.line").alias("line"))
    )
    return first.mapInPandas(_names, "shard_id long, header_id long, names array<string>")


def shard_headers(raw: DataFrame, files: DataFrame) -> DataFrame:
    """One row per shard with lines: names, feed, seq and the preceding shard of its feed.

    Shards without any line are passed over; lines without a file entry form no feed. ``gone``
    and ``fresh`` are the names that left and came. The rows are told apart by the fingerprint
    of their names: equal ones are not compared any further.
    """
    meta = files.groupBy("shard_id").agg(F.min("feed").alias("feed"), F.min("seq").alias("seq"), F.min("column_spec").alias("column_spec"))
    w = Window.partitionBy("feed").orderBy("seq", "shard_id")
    known = F.col("feed").isNotNull()
    got = headers(raw).join(meta, "shard_id", "left").withColumn("print", F.sha2(F.concat_ws("\n", F.array_sort("names")), 256))
    got = got.withColumns({f"prev_{c}": F.when(known, F.lag(c).over(w)) for c in ("shard_id", "names", "print")}).withColumnRenamed("prev_shard_id", "prev_id")
    moved = F.col("print") != F.col("prev_print")
    gone, fresh = F.array_except("prev_names", "names"), F.array_except("names", "prev_names")
    return got.withColumns({"gone": F.when(moved, gone), "fresh": F.when(moved, fresh)}).drop("print", "prev_print")


# ---- facts ------------------------------------------------------------------------------

FACTS = "shard_id long, raw_id long, pattern string, tokens array<long>, now array<string>, next array<string>"
FIELDS = "shard_id long, raw_id long, pattern string, fields array<string>"


def _held(p: dl.Parsed, wanted: pa.Array) -> pa.Array:
    """For each row the values of the columns whose numbers ``wanted`` lists; null where it has no list."""
    part = wanted.take(pa.array(p.at))
    size = pa.compute.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pa.compute.list_flatten(part).to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.concatenate([[0], np.cumsum(size)])
    rows = np.repeat(np.arange(p.n), size)
    values, there = dl.present(p.cells(rows, flat))
    values = pa.compute.if_else(pa.array(there), values, pa.scalar(None, pa.string()))
    return pa.ListArray.from_arrays(pa.array(place, pa.int32()), values, mask=part.is_null())


def _parse(t: pa.Table):
    """Reason code of each row, and the sound rows by width with their looked-at columns."""
    code, parsed = dl.parse_batch(dl.one(t.column("line")), t.column("width").to_numpy())
    return code, [(p, [dl.Cells(c) for c in p.columns]) for p in parsed]


def _facts(batches):
    for t in narrow_batches(batches, CHUNK_ROWS, "line"):
        code, parsed = _parse(t)
        ids = [dl.one(t.column(k)) for k in ("shard_id", "raw_id")]
        now, nxt = (dl.one(t.column(k)) for k in ("now", "next"))
        broken = np.flatnonzero(code)
        none = lambda n, kind: pa.nulls(n, pa.list_(kind))
        parts = [(broken, pa.array([dl.BROKEN[c] for c in code[broken]], pa.string()), none(len(broken), pa.int64()), *[none(len(broken), pa.string())] * 2)]
        for p, columns in parsed:
            seen = np.flatnonzero((now.is_valid().to_numpy(zero_copy_only=False) | nxt.is_valid().to_numpy(zero_copy_only=False))[p.at])
            tokens, size = np.empty(0, np.int64), np.zeros(p.n, np.int64)
            if len(seen):
                every = np.stack([c.tokens(TELLING) for c in columns], axis=1)[seen]
                every[every < 0] = np.iinfo(np.int64).max
                every = np.sort(every, axis=1)[:, :LINKS]
                size[seen] = (every < np.iinfo(np.int64).max).sum(1)
                tokens = every[every < np.iinfo(np.int64).max]
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(tokens))
            parts.append((p.at, dl.patterns(columns, p.n), listed, _held(p, now), _held(p, nxt)))
        for at, *cols in parts:
            if len(at):
                yield pa.RecordBatch.from_arrays([x.take(pa.array(at)) for x in ids] + cols, names=["shard_id", "raw_id", "pattern", "tokens", "now", "next"])


def _fields(batches):
    """Sound rows with all their values."""
    for t in narrow_batches(batches, CHUNK_ROWS, "line"):
        ids = [dl.one(t.column(k)) for k in ("shard_id", "raw_id")]
        for p, columns in _parse(t)[1]:
            w = len(columns)
            rows = np.repeat(np.arange(p.n), w)
            values = p.cells(rows, np.tile(np.arange(w), p.n))
            fields = pa.ListArray.from_arrays(pa.array(np.arange(p.n + 1) * w, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([x.take(pa.array(p.at)) for x in ids] + [dl.patterns(columns, p.n), fields], names=["shard_id", "raw_id", "pattern", "fields"])


def _with_shard(lines: DataFrame, shards: DataFrame, few: bool) -> DataFrame:
    """Rows of all shards with columns of their shard, the header lines left out.

    ``few`` tells that the shards have been counted and are at most FEW_SHARDS: then they are
    sent to the tasks and the lines stay where they are. Otherwise a shard is repeated for each
    salt and its lines are salted, so that the join does not put a hot shard into one task.
    """
    if few:
        got = lines.join(F.broadcast(shards), "shard_id")
    else:
        salted = lines.withColumn("salt", F.pmod(F.xxhash64("raw_id"), F.lit(SALTS)).cast("int"))
        got = salted.join(shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["shard_id", "salt"]).drop("salt")
    return got.where(F.col("raw_id") != F.col("header_id")).drop("header_id")


def facts(raw: DataFrame, shards: DataFrame, few: bool) -> DataFrame:
    """``shard_id, raw_id, pattern, tokens, now, next`` of each row, in one pass over the lines.

    ``now`` has the values of the columns that are new against the preceding shard, ``next``
    those of the columns that the following one lacks; both, and the tokens that link rows, are
    null for shards that are not compared. Copies of a line give copies of its fact.
    """
    both = shards.where((F.size("gone") > 0) & (F.size("fresh") > 0))
    place = lambda asked: F.transform(asked, lambda n: (F.array_position(F.col("names"), n) - 1).cast("int"))
    after = both.select(F.col("prev_id").alias("shard_id"), F.col("gone").alias("lost"))
    compared = (F.size("gone") > 0) & (F.size("fresh") > 0)
    info = shards.join(after, "shard_id", "left").select(
        "shard_id", "header_id", F.size("names").alias("width"), F.when(compared, place(F.col("fresh"))).alias("now"), place(F.col("lost")).alias("next")
    )
    return _with_shard(carrying(raw).select("shard_id", "raw_id", "line"), info, few).mapInArrow(_facts, FACTS)


# ---- renames ----------------------------------------------------------------------------


def renames(seen: DataFrame, shards: DataFrame) -> DataFrame:
    """``shard_id, old_name, new_name``: columns that go on under another name.

    Rows of a shard and of the preceding one are linked where they share values that are unique
    in either file, whatever the column; a lost and a new column are one if most linked rows, of
    those that have a value, agree in it. Copies of a row change nothing: a value is unique if
    only one row number has it, and linked rows are told apart by theirs.
    """
    both = shards.where((F.size("gone") > 0) & (F.size("fresh") > 0))
    now = seen.where("now is not null").select(F.col("shard_id").alias("pair"), F.lit(1).alias("side"), "raw_id", "tokens", F.col("now").alias("held"))
    before = seen.where("next is not null").join(both.select(F.col("prev_id").alias("shard_id"), F.col("shard_id").alias("pair")), "shard_id")
    rows = now.unionByName(before.select("pair", F.lit(0).alias("side"), "raw_id", "tokens", F.col("next").alias("held")))
    one = lambda f, s: f(F.when(F.col("side") == s, F.col("raw_id")))
    shared = (
        rows.select("pair", "side", "raw_id", F.explode("tokens").alias("token"))
        .groupBy("pair", "token")
        .agg(one(F.min, 0).alias("r0"), one(F.max, 0).alias("m0"), one(F.min, 1).alias("r1"), one(F.max, 1).alias("m1"))
        .where("r0 = m0 and r1 = m1")
    )
    votes = shared.groupBy("pair", "r0", "r1").agg(F.count(F.lit(1)).alias("votes"))
    best = lambda r, o: F.row_number().over(Window.partitionBy("pair", r).orderBy(F.desc("votes"), o))
    linked = votes.withColumn("b0", best("r0", "r1")).where("b0 = 1").withColumn("b1", best("r1", "r0")).where("b1 = 1").select("pair", "r0", "r1")
    side = lambda s: rows.where(F.col("side") == s).select("pair", F.col("raw_id").alias(f"r{s}"), F.col("held").alias(f"h{s}")).dropDuplicates(["pair", f"r{s}"])
    held = linked.join(side(0), ["pair", "r0"]).join(side(1), ["pair", "r1"])
    cells = held.select("pair", F.posexplode("h0").alias("i", "v0"), "h1").select("pair", "i", "v0", F.posexplode("h1").alias("j", "v1"))
    x, y = (F.expr(f"try_cast({v} as double)") for v in ("v0", "v1"))
    same = F.coalesce((F.col("v0") == F.col("v1")) | (F.abs(x - y) <= 1e-6 * F.greatest(F.abs(x), F.abs(y))), F.lit(False))
    score = (
        cells.where(F.col("v0").isNotNull() | F.col("v1").isNotNull())
        .groupBy("pair", "i", "j")
        .agg((F.sum(same.cast("int")) / F.count(F.lit(1))).alias("part"), F.count(F.lit(1)).alias("n"))
        .where(F.col("part") > 0.5)
    )
    only = lambda a, b: F.row_number().over(Window.partitionBy("pair", a).orderBy(F.desc("part"), F.desc("n"), b))
    found = score.withColumn("bi", only("i", "j")).withColumn("bj", only("j", "i")).where((F.col("bi") == 1) & (F.col("bj") == 1))
    return found.join(both.select(F.col("shard_id").alias("pair"), "gone", "fresh"), "pair").select(
        F.col("pair").alias("shard_id"), F.expr("gone[i]").alias("old_name"), F.expr("fresh[j]").alias("new_name")
    )


# ---- chained rules ------------------------------------------------------------------------

RULES = "shard_id long, header_id long, feed string, seq int, prev_id long, names array<string>, roles array<int>, canonical array<string>, old_names array<string>, new_names array<string>"


def _chain(batches):
    """Walk each feed's shards in order, carrying only the last shard's rules."""
    feed, role_of, canon = None, {}, {}
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            names = list(r.names)
            if r.feed is None or r.feed != feed:
                feed, role_of, canon = r.feed, {}, {}
            moved = dict(zip(r.old_names, r.new_names)) if r.old_names is not None else {}
            spec, have = dl.column_spec(r.column_spec), set(names)
            roles = {}
            for role, default in dl.DEFAULTS.items():
                last = role_of.get(role)
                roles[role] = next((c for c in (spec.get(role), default, last, moved.get(last)) if c is not None and c in have), None)
            back = {v: k for k, v in moved.items()}
            by_role = {c: role for role, c in roles.items() if c is not None}
            now, used = {}, set()
            for n in names:
                c = by_role.get(n) or canon.get(n) or canon.get(back.get(n)) or n
                while c in used:
                    c += "'"
                used.add(c)
                now[n] = c
            role_of, canon = roles, now
            out.append((r.shard_id, r.header_id, r.feed, r.seq, r.prev_id, names, [names.index(roles[k]) if roles[k] else -1 for k in dl.ROLES], [now[n] for n in names], list(moved), list(moved.values())))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RULES.split(", ")]).astype({"prev_id": "Int64", "seq": "Int32"})


def _in_order(df: DataFrame) -> DataFrame:
    """A feed's shards in one task in order; a shard is one small row."""
    return df.repartition("feed").sortWithinPartitions("feed", "seq", "shard_id")


def rules(shards: DataFrame, moved: DataFrame) -> DataFrame:
    """How to read each shard: the field of each role and the canonical name of each column.

    A role's column is that of ``column_spec``, else the default name, else the column that
    the preceding shard's column of the role kept or was renamed to. A column keeps the name
    under which it first came through all renames. A feed's shards stream through one task in
    order, with the state of one shard.
    """
    listed = moved.groupBy("shard_id").agg(F.array_sort(F.collect_list(F.struct("old_name", "new_name"))).alias("m"))
    chained = shards.join(listed, "shard_id", "left").select(
        "shard_id", "header_id", "feed", "seq", "prev_id", "column_spec", "names", F.col("m.old_name").alias("old_names"), F.col("m.new_name").alias("new_names")
    )
    return _in_order(chained).mapInPandas(_chain, RULES)


def reason_of(pattern: Column, roles: Column) -> Column:
    """Why a row with this pattern cannot be loaded where the roles have these columns; null if it can."""
    why = F.when(pattern == dl.BROKEN[1], dl.REASONS[1]).when(pattern == dl.BROKEN[2], dl.REASONS[2])
    for r in dl.CHECKED:
        at = roles[dl.ROLES.index(r)]
        symbol = F.when(at >= 0, F.substring(pattern, at + 1, F.lit(1))).otherwise(F.lit(dl.MISSING))
        bad = ~symbol.isin(dl.RA_ALLOWED) if r == "ra" else ~symbol.isin(dl.DEC_ALLOWED) if r == "dec" else symbol == dl.TEXT
        why = why.when(bad, f"bad_{r}")
    return why


# ---- versions and steps -------------------------------------------------------------------

STEP = "struct<step: string, old_name: string, new_name: string, from_type: string, to_type: string, reported: boolean>"
VERSIONS = f"shard_id long, feed string, seq int, version int, fingerprint string, names array<string>, canonical array<string>, known array<string>, steps array<{STEP}>"


def _versions(batches):
    """Walk each feed's shards again, now with the types of their columns, and write down the steps from version to version."""
    feed, last, version, mark = None, None, 0, None
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.feed is None or r.feed != feed:
                feed, last, version, mark = r.feed, None, 0, None
            names, own = list(r.names), dict(zip(r.typed, r.types)) if r.typed is not None else {}
            moved = dict(zip(r.old_names, r.new_names))
            back = {v: k for k, v in moved.items()}
            before = last or {"own": {}, "known": {}}
            # a column without values keeps the type that it had
            known = {n: own.get(n) or before["known"].get(n) or before["known"].get(back.get(n)) or "" for n in names}
            here = hashlib.sha256("\n".join(sorted(f"{n}:{t}" for n, t in known.items())).encode()).hexdigest()[:16]
            steps = []
            if last is not None and here != mark:
                steps += [("rename", a, b, before["known"].get(a), known.get(b), True) for a, b in moved.items()]
                steps += [("drop", n, "", t, None, True) for n, t in before["known"].items() if n not in known and n not in moved]
                steps += [("default", "", n, None, t, True) for n, t in known.items() if n not in before["known"] and n not in back]
                for n, t in known.items():
                    was, old = before["known"].get(n), back.get(n)
                    if n in before["known"] and t != was and was:
                        steps.append(("cast", n, n, was, t, n in own and n in before["own"]))
                    elif old is not None and before["known"].get(old) not in ("", t):
                        steps.append(("cast", n, n, before["known"].get(old), t, False))
            version += here != mark
            last, mark = {"own": own, "known": known}, here
            out.append((r.shard_id, r.feed, r.seq, version, here, names, list(r.canonical), [known[n] for n in names], [dict(zip(("step", "old_name", "new_name", "from_type", "to_type", "reported"), s)) for s in steps]))
        yield pd.DataFrame(out, columns=["shard_id", "feed", "seq", "version", "fingerprint", "names", "canonical", "known", "steps"]).astype({"seq": "Int32"})


class ShardSet:
    """The shards of all feeds with their drift resolved; each result is one DataFrame.

    Null lines carry nothing. A shard without a file entry has no feed, hence no changes, and
    is read by the default names. Repeated rows count once. Empty tables give empty results;
    extra columns are ignored.
    """

    def __init__(self, raw: DataFrame, files: DataFrame) -> None:
        self.raw = raw.select("raw_id", "shard_id", "line_no", "line")
        files = files.select("shard_id", "feed", "seq", "column_spec")
        self.shards = cut(shard_headers(self.raw, files))
        self.few = self.shards.count() <= FEW_SHARDS
        self.facts = stored(facts(self.raw, self.shards, self.few))
        self.rules = cut(rules(self.shards, renames(self.facts, self.shards)))
        self._versions = None

    def rejected(self) -> DataFrame:
        """``raw_id, shard_id, reason`` of each row that cannot become a catalogue row."""
        roles = self.rules.select("shard_id", "roles")
        seen = self.facts.select("shard_id", "raw_id", "pattern").join(F.broadcast(roles) if self.few else roles, "shard_id")
        return seen.select("raw_id", "shard_id", reason_of(F.col("pattern"), F.col("roles")).alias("reason")).where("reason is not null").distinct()

    def types(self) -> DataFrame:
        """``shard_id, name, type``: the type of most values of the loadable rows; ties go to the wider.

        Rows are counted by their pattern, of which a shard has few, before anything is joined.
        """
        counted = self.facts.select("shard_id", "raw_id", "pattern").distinct().groupBy("shard_id", "pattern").agg(F.count(F.lit(1)).alias("n"))
        good = counted.join(self.rules.select("shard_id", "names", "roles"), "shard_id").where(reason_of(F.col("pattern"), F.col("roles")).isNull())
        cells = good.select("shard_id", "n", F.posexplode("names").alias("at", "name"), "pattern").withColumn("symbol", F.substring("pattern", F.col("at") + 1, F.lit(1)))
        kind = F.when(F.col("symbol") == dl.TEXT, "text").when(F.col("symbol").isin(dl.INTEGERS), "integer").when(F.col("symbol") != dl.MISSING, "decimal")
        total = cells.withColumn("kind", kind).groupBy("shard_id", "name").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in TYPES])
        most = F.greatest(*TYPES)
        widest = F.coalesce(*[F.when(F.col(k) == most, F.lit(k)) for k in reversed(TYPES)])
        return total.where(most > 0).select("shard_id", "name", widest.alias("type"))

    def versions(self) -> DataFrame:
        """Schema version of each shard in its feed, the fingerprint of its names and types, and the steps that lead to it.

        A shard with the fingerprint of the preceding one has its version and no steps. Steps
        are ``rename``, ``drop``, ``default`` (a new column, null in all earlier files) and
        ``cast``; a cast is ``reported`` if both neighbouring files have values of the column.
        """
        if self._versions is None:
            typed = self.types().groupBy("shard_id").agg(F.array_sort(F.collect_list(F.struct("name", "type"))).alias("t"))
            walked = self.rules.join(typed, "shard_id", "left").select("*", F.col("t.name").alias("typed"), F.col("t.type").alias("types"))
            self._versions = cut(_in_order(walked).mapInPandas(_versions, VERSIONS))
        return self._versions

    def steps(self) -> DataFrame:
        """The migration table: ``feed, version, shard_id, step, old_name, new_name, from_type, to_type, reported``.

        ``version`` is the one that a step leads to, ``shard_id`` the first shard that has it.
        """
        return self.versions().select("feed", "version", "shard_id", F.explode("steps").alias("s")).select("feed", "version", "shard_id", "s.*")

    def changes(self) -> DataFrame:
        """``shard_id, change, old_name, new_name`` against the preceding shard of the feed: the reported steps."""
        named = F.create_map(*[F.lit(x) for kv in {"rename": "renamed", "drop": "removed", "default": "added", "cast": "retyped"}.items() for x in kv])
        return self.steps().where("reported").select("shard_id", named[F.col("step")].alias("change"), "old_name", "new_name")

    def loaded(self) -> DataFrame:
        """All other rows as one table: typed roles, and all fields by canonical name in the type of the feed's column.

        Each shard is routed by its version: renames have given the canonical names, casts the
        widest type that a column has in the feed, defaults a null for the columns that a shard
        lacks. The other fields are in ``integers``, ``decimals`` and ``texts``; a value that
        is not of its column's type is null there, and kept in ``texts``.
        """
        v = self.versions()
        rank = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("c.type"))
        columns = v.select(F.coalesce("feed", F.concat(F.lit("\x00"), F.col("shard_id").cast("string"))).alias("route"), F.explode(F.arrays_zip(F.col("canonical").alias("name"), F.col("known").alias("type"))).alias("c"))
        wide = columns.groupBy("route", F.col("c.name").alias("name")).agg(F.max(rank).alias("rank"))
        per = wide.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("name", "rank"))).alias("columns"))
        routes = v.withColumn("route", F.coalesce("feed", F.concat(F.lit("\x00"), F.col("shard_id").cast("string")))).join(per, "route")
        routes = routes.join(self.rules.select("shard_id", "roles"), "shard_id").select("shard_id", "feed", "version", "canonical", "roles", "columns")
        info = self.shards.select("shard_id", "header_id", F.size("names").alias("width"))
        rows = _with_shard(carrying(self.raw).select("shard_id", "raw_id", "line"), info, self.few).mapInArrow(_fields, FIELDS).dropDuplicates(["shard_id", "raw_id"])
        good = rows.join(routes, "shard_id").where(reason_of(F.col("pattern"), F.col("roles")).isNull())
        clean = F.transform("fields", lambda f: F.when(~F.lower(F.trim(f)).isin("", "null"), F.trim(f)))
        good = good.withColumn("values", clean).withColumn("of", F.map_from_arrays("canonical", "values"))
        role = lambda r, kind: F.expr(f"try_cast(get(values, roles[{dl.ROLES.index(r)}]) as {kind})").alias(r)
        pick = lambda k: F.filter("columns", lambda c: c["rank"] == k)
        cell = lambda c: F.element_at("of", c["name"])
        typed = lambda k, kind: F.map_from_entries(F.transform(pick(k), lambda c: F.struct(c["name"], cell(c).try_cast(kind))))
        stray = F.filter("columns", lambda c: (c["rank"] == 3) | (c["rank"] == 0) | (cell(c).isNotNull() & F.when(c["rank"] == 1, cell(c).try_cast("bigint").isNull()).otherwise(cell(c).try_cast("double").isNull())))
        return good.select(
            "shard_id", "raw_id", "feed", "version", role("source_id", "bigint"), *[role(r, "double") for r in dl.CHECKED],
            typed(1, "bigint").alias("integers"), typed(2, "double").alias("decimals"), F.map_from_entries(F.transform(stray, lambda c: F.struct(c["name"], cell(c)))).alias("texts"),
        )
