import random
import re
import unicodedata

import numpy as np
import pytest
from conftest import DATA

from skyframe.llm import leakage, packing

DOCS, ITEMS = "doc_id long, text string, score string", "item_id long, lang string, passage string, answer string"
WORDS = [f"word{i} thing{i}" for i in range(60)]
PASSAGE = ". ".join(WORDS[:30])
CJK = "岫岑阙在霁筠芷岑门下数到条光迹后来份微光落湄砚汀黛榆漪珩澈峤的粗糙背景被排除但又移动"


def found(spark, docs, items):
    df = leakage.leaks(spark.createDataFrame([(*d, "c") for d in docs], DOCS), spark.createDataFrame([(*i, "a") for i in items], ITEMS))
    return {(r["doc_id"], r["item_id"]) for r in leakage.exact(df).collect()}, df


def words(n, sep=" "):
    return sep.join(" ".join(WORDS).split()[:n])


def test_windows_case_forms_and_breaks(spark):
    docs = [
        (1, "before " + words(12) + " after"), (2, words(11)), (3, words(40, "\n").upper()), (4, unicodedata.normalize("NFKC", words(14)).translate({ord(c): ord(c) + 0xFEE0 for c in "abcdefghijklmnopqrstuvwxyz"})),
        (5, "wo​rd0 th­ing0 " + " ".join(words(14).split()[2:])), (6, None), (7, ""), (8, "x " + CJK[3:27] + "尾"), (9, CJK[3:26]), (10, " ".join(CJK[:30])), (1, "before " + words(12) + " after"),
        (11, ", ".join(words(60).split()[20:40]) + " gap " * 3000 + words(15)),
    ]
    got, df = found(spark, docs, [(1, "en", PASSAGE), (2, "zh", CJK), (3, "en", "too short"), (4, None, None), (5, "fr", "")])
    assert got == {(1, 1), (3, 1), (4, 1), (5, 1), (8, 2), (10, 2), (11, 1)}
    assert df.count() == len({(r["doc_id"], r["item_id"]) for r in df.collect()})


def test_edited_copies_are_scored(spark):
    edited = words(60).split()
    edited[20:22] = ["other"]
    _, df = found(spark, [(1, " ".join(edited))], [(1, "en", PASSAGE)])
    r = df.first()
    assert r["item_tokens"] == 60 and 50 <= r["score"] < 60 and r["longest_run"] == 38


def test_edited_copies_without_an_intact_window_are_scored(spark):
    copy = words(60).split()
    copy[9::10] = ["other"] * 6
    letters = list(CJK)
    letters[20:22] = "尾尾"
    _, df = found(spark, [(1, " ".join(copy)), (2, PASSAGE), (3, "".join(letters))], [(1, "en", PASSAGE), (2, "zh", CJK)])
    got = {(r["doc_id"], r["item_id"]): r for r in df.collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2)}
    # 54 words agree and 6 differ, but the last is at the end
    assert got[1, 1]["longest_run"] == 9 and got[1, 1]["score"] == 54 - 5
    assert got[3, 2]["longest_run"] == 20


def edited(tokens, every, rng, fresh):
    """A copy with one edit in every ``every`` tokens: a change, a loss or an addition."""
    out = []
    for k in range(0, len(tokens), every):
        part = list(tokens[k : k + every])
        at, how = rng.randrange(len(part)), rng.choice("cla")
        part[at : at + (how != "a")] = [] if how == "l" else [fresh()]
        out += part
    return out


def test_recall_of_edited_copies(spark):
    """Copies of real passages with an edit in every 4, 5, 6 or 8 words, planted in real documents."""
    rng = random.Random(5)
    fresh = lambda: f"neu{rng.randrange(10**6)}"
    items = [r for r in spark.read.parquet(f"{DATA}/eval_items.parquet").collect() if r["lang"] not in leakage.UNSPACED]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").distinct().collect()]
    planted, top = {}, 10**6
    for every in (4, 5, 6, 8):
        for r in items[:: 2]:
            host = docs[rng.randrange(len(docs))][1]
            copy = edited(re.findall(r"[^\W_]+", leakage.fold(r["passage"])), every, rng, fresh)
            top += 1
            planted[top, r["item_id"]] = every
            docs.append((top, f"{host} {' '.join(copy)} {host[:200]}"))
    got, df = found(spark, docs, [(r["item_id"], r["lang"], r["passage"]) for r in items])
    have = {(r["doc_id"], r["item_id"]) for r in df.collect()}
    recall = {e: sum(k in have for k, v in planted.items() if v == e) / sum(v == e for v in planted.values()) for e in (4, 5, 6, 8)}
    assert min(recall.values()) >= 0.9, recall
    assert got <= have


def test_recall_of_edited_copies_without_word_spaces(spark):
    rng = random.Random(6)
    items = [(r["item_id"], r["lang"], r["passage"]) for r in spark.read.parquet(f"{DATA}/eval_items.parquet").collect() if r["lang"] in leakage.UNSPACED]
    docs = []
    for i, _, p in items:
        docs += [(i * 10 + n, "".join(edited(re.findall(r"[^\W_]", leakage.fold(p)), every, rng, lambda: chr(0xAC00 + rng.randrange(9000))))) for n, every in enumerate((6, 8))]
    have = {(r["doc_id"], r["item_id"]) for r in found(spark, docs, items)[1].collect()}
    assert sum((d, d // 10) in have for d, _ in docs) >= 0.9 * len(docs)


def test_unrelated_texts_do_not_leak(spark):
    rng = random.Random(7)
    word = lambda: f"w{int(rng.paretovariate(0.7))}"
    docs = [(i, " ".join(word() for _ in range(400))) for i in range(100)]
    items = [(i, "en", " ".join(word() for _ in range(60))) for i in range(20)]
    got, df = found(spark, docs, items)
    assert not got and df.count() <= 0.01 * len(docs) * len(items)


def test_short_passages_leak_as_a_whole(spark):
    docs = [(1, "x alpha beta gamma delta y"), (2, "alpha beta other delta"), (3, "Gamma!"), (4, "one two")]
    got, df = found(spark, docs, [(1, "en", "alpha beta gamma delta"), (2, "en", "gamma"), (3, "en", "one two"), (4, "en", "...")])
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in df.collect()} == {(1, 1, 4), (1, 2, 1), (3, 2, 1), (4, 3, 2)} and not got


def test_an_item_with_two_passages_and_repeated_rows(spark):
    items = [(1, "en", words(20)), (1, "en", PASSAGE[-200:]), (1, "en", words(20))]
    got, df = found(spark, [(1, words(15)), (2, PASSAGE[-150:]), (2, PASSAGE[-150:])], items)
    assert got == {(1, 1), (2, 1)} and df.count() == 2


def test_alignment_of_many_pairs_is_that_of_each():
    rng = np.random.default_rng(3)

    def plain(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(max(0, row[j - 1] + (1 if x == y else -1), row[j] - 1, new[j - 1] - 1))
                best = max(best, new[j])
            row = new
        return best

    pairs = [(rng.integers(0, 5, rng.integers(1, 30)).astype(np.uint64), rng.integers(0, 5, rng.integers(0, 90)).astype(np.uint64)) for _ in range(60)]
    assert leakage.smith_waterman(*map(list, zip(*pairs))).tolist() == [plain(a.tolist(), b.tolist()) for a, b in pairs]


def test_items_that_share_a_sentence_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 100)
    other = PASSAGE + ". " + ". ".join(WORDS[40:])
    got, _ = found(spark, [(1, PASSAGE), (2, ". ".join(WORDS[40:]))], [(1, "en", PASSAGE), (2, "en", other), (3, "de", "nothing of this kind " * 5)])
    assert got == {(1, 1), (1, 2), (2, 2)}


def test_empty_tables(spark):
    assert found(spark, [], [(1, "en", PASSAGE)])[0] == set()
    assert found(spark, [(1, PASSAGE)], [])[0] == set()


def test_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "eval_items"))
    word, letter = re.compile(r"[^\W_]+"), re.compile(r"[^\W_]")

    def windows(text, unspaced):
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", "".join(c for c in text if unicodedata.category(c) != "Cf")).casefold())
        t, n = (letter.findall(text), 24) if unspaced else (word.findall(text), 12)
        return {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}

    sets = [(r["item_id"], r["lang"] in ("ja", "zh"), windows(r["passage"], r["lang"] in ("ja", "zh"))) for r in items.collect()]
    want = set()
    for r in docs.where("text is not null").distinct().collect():
        mine = {u: windows(r["text"], u) for u in (True, False)}
        want |= {(r["doc_id"], i) for i, u, w in sets if mine[u] & w}
    for edits in (True, False):
        got = {(r["doc_id"], r["item_id"]) for r in leakage.exact(leakage.leaks(docs, items, edits)).collect()}
        assert got == want and want


KINDS = [(1, 10), (2, 64)]


def packed(spark, sizes):
    return packing.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), KINDS).toPandas()


def check(got, sizes):
    for kind, capacity in KINDS:
        mine = got[got.container_kind == kind]
        assert mine.groupby("doc_id").n_tokens.sum().to_dict() == dict(sizes)
        held = mine.dropna(subset=["container_id"]).groupby("container_id").n_tokens.sum()
        assert (held <= capacity).all()
        for doc, n in sizes:
            pieces = mine[mine.doc_id == doc]
            assert len(pieces) == (1 if n <= capacity else -(-n // capacity))
        assert not mine.duplicated(["doc_id", "piece"]).any()


def test_packing_splits_only_what_is_too_long(spark):
    sizes = [(1, 0), (2, 10), (3, 11), (4, 640), (5, 3), (6, 7), (7, 64), (8, 1)]
    check(packed(spark, sizes), sizes)


def test_packing_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 60)
    sizes = [(i, 1 + (i * 7919) % 40) for i in range(1500)]
    got = packed(spark, sizes)
    check(got, sizes)
    mine = got[got.container_kind == 2]
    assert mine.n_tokens.sum() / (mine.container_id.nunique() * 64) > 0.93


def test_packing_that_cannot_be_improved_ends(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 50)
    sizes = [(i, 6) for i in range(700)]
    got = packed(spark, sizes)
    check(got, sizes)
    assert got[got.container_kind == 1].container_id.nunique() == 700
    assert got[got.container_kind == 2].container_id.nunique() <= 72


def test_packing_of_fifty_groups_is_as_good_as_of_one(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 100)
    sizes = [(i, 1 + (i * i * 7919) % 40) for i in range(5000)]
    got = packed(spark, sizes)
    check(got, sizes)
    alone = len(packing.best_fit([n for _, n in sizes], 64))  # all items in one group
    assert got[got.container_kind == 2].container_id.nunique() <= 1.02 * alone


def test_packing_nothing(spark):
    assert len(packed(spark, [])) == 0


def test_best_fit_never_overflows():
    bins = packing.best_fit([5, 5, 5, 4, 3, 3, 2, 1], 10)
    assert sorted(i for b in bins for i in b) == list(range(8)) and len(bins) == 3


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (4, "a" * 100_000), (None, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df).collect()}
    enc = packing._encoding(f"{packing.TOKENIZERS}/{packing.VOCABULARY}")
    assert got[1] == len(enc.encode_ordinary("hello world")) and enc.decode(enc.encode_ordinary("hello world")) == "hello world"
    assert got[2] == 0 and got[3] == 0 and got[4] > 1000 and set(got) == {1, 2, 3, 4}


def test_container_kinds_are_bounded(spark):
    df = spark.range(5).selectExpr("id container_kind", "cast(id + 1 as int) capacity_tokens")
    assert len(packing.container_kinds(df)) == 5
    with pytest.raises(ValueError):
        packing.container_kinds(df, most=4)
