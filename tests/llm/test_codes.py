"""Pieces, vector codes and the audit of filters, against the library and brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import filter_audit, pieces, registry, vector_codes
from tests.conftest import DATA

from .conftest import frame

# pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def ids_of(text):
    return array("i", pieces.Encoder.of(pieces.model_path()).encode(text)).tolist()


def texts_of(kind, rng, known):
    if kind == "marks":
        return "".join(rng.choice("abcdefghij \n\r\t▁  ▁▁éü中文😀\0<s></s>[](){};:*/'\"-=_#") for _ in range(rng.randint(0, 30)))
    if kind == "joined":  # pieces side by side are mostly not what the text of both is made of
        return "".join(rng.choice(known) for _ in range(rng.randint(1, 6)))
    if kind == "bare":
        return "".join(rng.choice(known).strip("▁") for _ in range(rng.randint(1, 8)))
    return "".join(chr(rng.choice([rng.randint(0, 300), rng.randint(0x3000, 0x9FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(10))


@pytest.mark.parametrize("kind", ["marks", "joined", "bare", "any"])
def test_ids_are_the_library_s(library, kind):
    rng = random.Random(kind)
    known = [library.id_to_piece(i) for i in range(259, 32000)]
    for _ in range(3000):
        text = texts_of(kind, rng, known)
        wanted = library.encode(text)
        assert ids_of(text) == wanted, text
        assert pieces.Decoder.of(pieces.model_path()).decode(wanted) == library.decode(wanted)


def test_any_ids_decode_as_the_library_does(library):
    rng, decoder = random.Random(2), pieces.Decoder.of(pieces.model_path())
    for _ in range(5000):
        ids = [rng.randint(0, 31999) if rng.random() < 0.4 else rng.randint(0, 300) for _ in range(rng.randint(0, 8))]
        assert decoder.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("text", ["x" * 20_000, "9" * 20_000, "ab" * 10_000, "-" * 10_001, " " * 5_000, "中" * 5_000, "====" * 333 + "//" * 500, "the same word again, " * 1000])
def test_long_runs(library, text):
    assert ids_of(text) == library.encode(text)


def test_cuts_are_never_crossed(library, monkeypatch):
    """Without cuts, memory and a list of cuts the ids are the same."""
    rng = random.Random(3)
    known = [library.id_to_piece(i) for i in range(259, 32000)]
    encoder = pieces.Encoder(pieces.model_path())
    monkeypatch.setattr(pieces, "LONG_TEXT", 10)
    monkeypatch.setattr(pieces, "MEMO_CUTS", 50)
    monkeypatch.setattr(pieces, "MEMO_PAIRS", 100)
    for _ in range(500):
        text = texts_of("joined", rng, known)
        whole = array("i", encoder.tokens("▁" + text.replace(" ", "▁"))).tolist()
        assert whole == array("i", encoder.encode(text)).tolist() == library.encode(text)


def test_pairs_are_compatible_where_the_library_leaves_them(library):
    rng, encoder = random.Random(5), pieces.Encoder.of(pieces.model_path())
    words = [x for x in encoder.ids if not x.startswith("▁")]
    for _ in range(3000):
        a, b = rng.choice(words), rng.choice(words)
        found = [library.id_to_piece(i) for i in library.encode("(" + a + b)]  # nothing joins "(" and a letter, but marks may
        if not found[0].startswith("▁(") or found[0] != "▁(":
            continue
        assert encoder.compatible(encoder.ids[a], encoder.ids[b]) == (found[1:] == [a, b])


def test_documents_are_encoded_and_decoded(library, docs, awkward_rows):
    found = pieces.encode(docs, decoded=True).collect()
    assert len(found) == len(awkward_rows)
    for r in found:
        text = r["row"]["text"] or ""
        assert r["ids"] == library.encode(text) and r["decoded"] == library.decode(r["ids"])
    again = pieces.decode(pieces.encode(docs, keep=["doc_id"])).collect()
    assert Counter(r["decoded"] for r in again) == Counter(r["decoded"] for r in found)


def test_ids_that_are_null_or_unknown(spark, library):
    tokens = spark.createDataFrame([(1, None), (2, []), (3, [None, 278])], "k int, ids array<int>")
    assert {r["k"]: r["decoded"] for r in pieces.decode(tokens).collect()} == {1: None, 2: "", 3: library.decode([278])}
    with pytest.raises(Exception, match="not one of the model's"):
        pieces.decode(spark.createDataFrame([(1, [40_000])], "k int, ids array<int>")).collect()


def test_op11_digests(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    found = registry.QUERIES["op11_sentencepiece"](spark, DATA).collect()
    assert {r["doc_id"] for r in found} == set(texts)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in found:
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(b"\x12\x02\x18\x01")  # a trainer's part that says: model type 1
    with pytest.raises(ValueError, match="byte pairs"):
        pieces.Vocabulary(str(path))


# vector codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, row string, v int"


def coded_by_hand(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * np.float32(x).item()) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min((away(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in kept:
                held[nearest(p, cut(v)[p])[1]].append(cut(v)[p])
            books[p] = [tuple(sum(c) // len(held[k]) for c in zip(*held[k], strict=True)) if k in held else e for k, e in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        found = [nearest(p, x) for p, x in enumerate(cut(v))]
        out.append((i, label, bytes(k for _, k in found), sum(d for d, _ in found)))
    return out, ",".join(str(x) for book in books for e in book for x in e)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", None, 1) for i, v, label in rows], VECTORS)


@pytest.mark.parametrize("n", [5, 300])
def test_codes_by_hand(spark, monkeypatch, n):
    monkeypatch.setattr(vector_codes, "BLOCK_BYTES", 64 * 40)
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(3, rows[3][1], 0), (3, rows[1][1], 1), (None, rows[2][1], None), (1000, None, 0), (1001, [], 0), (1002, [0.5] * 15 + [None], 1), (1003, [float("nan")] * 16, 1), (1004, [0.5] * 15 + [-math.inf], 1)]
    rng.shuffle(rows)
    wanted, book = coded_by_hand(rows)
    codes, found = vector_codes.compress(vectors(spark, rows).repartition(5))
    assert codes.select("row.*").columns == ["vec_id", "embedding", "label", "code", "row", "v"]
    assert Counter((r["row"]["vec_id"], r["row"]["label"], bytes(r["code"]), r["error"]) for r in codes.collect()) == Counter(wanted)
    assert vector_codes.written(found) == book


def test_op12_digests_and_labels(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)], rng.choice([0, 1, None])) for i in range(60)] + [(60, None, 1)]
    vectors(spark, rows).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    wanted, book = coded_by_hand(rows)
    sums = Counter()
    for _, label, _, error in wanted:
        sums[label] += error
    found = registry.QUERIES["op12_vector_codes"](spark, str(tmp_path)).collect()
    assert {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found} == {(i, code.hex(), error, sums[label]) for i, label, code, error in wanted}
    assert {r["codebooks_sha256"] for r in found} == {hashlib.sha256(book.encode()).hexdigest()}


def test_vectors_without_a_code(spark):
    for rows in ([], [(1, None, 0), (2, [None], 1), (3, [float("nan")], None)]):
        codes, book = vector_codes.compress(vectors(spark, rows))
        assert codes.count() == 0 and codes.columns == ["row", "code", "error"] and book.shape[1] == 0
    for bad in ([[1.0] * 8, [1.0] * 16], [[1.0] * 9]):
        with pytest.raises(ValueError, match="one length"):
            vector_codes.compress(vectors(spark, [(i, v, 0) for i, v in enumerate(bad)]))
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(vectors(spark, [(1, [1.0] * 7 + [1e9], 0)]))


# audit of filters


def audited_by_hand(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    rows = []
    for d, t, source in docs:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > first[t]}
        said = [(q, x) for i, q, x in labels if i == d and d is not None]
        rows.append((source or "", {k for k, v in fails.items() if v}, any(q == 1 for q, _ in said), any(x == 1 for _, x in said)))
    out, total = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                failing = [r for r in rows if r[0] == part and f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[part, f] += len(gone)
    return {(part, order, step): (*v, total[part, order[step - 1]]) for (part, order, step), v in out.items()}


def audit_rows(df):
    found = df.collect()
    rows = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.NUMBERS) for r in found}
    assert len(rows) == len(found)
    return rows


def test_audit_by_hand(spark, docs, awkward_rows, monkeypatch):
    monkeypatch.setattr(filter_audit, "PART_ROWS", 2)
    labels = [(0, 1, 0), (0, 0, 1), (1, 0, 0), (24, 1, None), (25, None, 1), (27, 1, 1), (None, 1, 1), (999, 1, 1), (5, 1, 0)]
    found = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert audit_rows(found) == audited_by_hand([(d, t, s) for d, t, _, s in awkward_rows], labels)


def test_audit_of_copies_without_ids_or_with_equal_ones(spark):
    text = "WORDS in # CAPITALS " * 60
    rows = [(7, text, None, "a"), (7, text, None, ""), (8, text, None, None), (None, text, None, "a"), (None, text, None, "a"), (3, "", None, "a"), (2, None, None, "a"), (9, text + " ", None, "a")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_rows(filter_audit.audit(frame(spark, rows), labels)) == audited_by_hand([(d, t, s) for d, t, _, s in rows], [])


def test_audit_of_nothing(spark, nothing):
    assert filter_audit.audit(nothing, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("n", range(7))
def test_swaps_lead_through_every_order(n):
    order = list(range(n))
    seen = {tuple(order)}
    for i in filter_audit.swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == math.factorial(n)


def test_walk_updates_only_the_swapped_steps():
    """What the walk has after each swap is what summing all steps anew gives, with two sums a swap."""
    table = np.random.default_rng(1).integers(0, 50, (3, 32, 3))
    walk = filter_audit.Walk(table)
    summed = []
    plain = walk.step
    walk.step = lambda s: summed.append(s) or plain(s)
    for k, (_, order, removed) in enumerate(walk):
        assert len(summed) == 2 * k
        fresh = filter_audit.Walk(table)
        fresh.order = order
        assert all((fresh.step(s) == removed[s]).all() for s in range(5))


def test_op13_is_whole(spark):
    found = registry.QUERIES["op13_filter_audit"](spark, DATA)
    parts = spark.read.parquet(f"{DATA}/documents.parquet").select(F.coalesce("source", F.lit(""))).distinct().count()
    assert found.count() == parts * 600
