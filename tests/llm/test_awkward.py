"""Each operator over awkward rows and over an empty table, against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import common, exact_dedup, language, licenses, line_dedup, mixing, near_dedup, packing, personal_data, pieces, sharding

from .conftest import SCHEMA

ALL = {
    "near": near_dedup.classes, "packing": packing.pack, "exact": exact_dedup.deduplicate, "personal": personal_data.find, "licenses": licenses.scan,
    "mixing": mixing.mix, "sharding": sharding.shard, "language": language.identify, "lines": line_dedup.deduplicate, "pieces": pieces.encode,
}


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_table(nothing, name):
    assert ALL[name](nothing).count() == 0


@pytest.mark.parametrize("name", sorted(set(ALL) - {"packing"}))
def test_every_row_comes_back_whole(docs, awkward_rows, name):
    found = ALL[name](docs).select("row.*")
    assert found.columns == SCHEMA.names
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in found.collect()) == Counter(awkward_rows)


def key(doc_id):
    return (doc_id is None, doc_id or 0)


def test_exact_dedup(docs, awkward_rows):
    groups = defaultdict(list)
    for d, t, *_ in awkward_rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    found = exact_dedup.deduplicate(docs).collect()
    for r in found:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r["row"]["text"] or "")
        ids = groups[norm]
        assert r["group_size"] == len(ids) and r["keep_id"] == min(ids, key=key)
        assert bytes(r["digest"]) == hashlib.sha256(norm.encode()).digest()
    assert sum(r["kept"] for r in found) == len(groups)
    assert all(r["row"]["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_exact_dedup_tells_clashing_digests_apart(docs):
    poor = lambda text: F.unhex(F.format_string("%02x", F.length(text) % 3))
    good = {(r["row"]["doc_id"], r["row"]["text"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.deduplicate(docs).collect()}
    assert {(r["row"]["doc_id"], r["row"]["text"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.deduplicate(docs, digest=poor).collect()} == good


def test_exact_dedup_in_small_batches_and_over_runs(spark, docs, tmp_path):
    whole = Counter((r["row"]["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.deduplicate(docs).collect())
    assert Counter((r["row"]["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.deduplicate(docs, files_per_batch=1).collect()) == whole
    plain = lambda states: {r["digest"]: r["n"] for r in states.select(F.hex("digest").alias("digest"), "n").collect()}
    folder = f"file://{tmp_path}/state"
    assert exact_dedup.land(docs, ["doc_id"], folder) == 0
    n = plain(exact_dedup.stream_state(spark, folder))
    assert sum(n.values()) == docs.count()
    for run in (1, 2):  # two more landings, each in a folder of its own: the state of the first run is still there
        assert exact_dedup.land(docs, ["doc_id"], folder) == run
    assert plain(exact_dedup.stream_state(spark, folder)) == {k: 3 * v for k, v in n.items()}


def test_exact_dedup_meets_earlier_runs(spark, tmp_path):
    """Hits on an earlier run's state are checked against the text at its locator."""
    poor = lambda text: F.unhex(F.format_string("%02x", F.length(text) % 3))
    batches = [[(5, "one text"), (9, "another"), (None, "no id")], [(7, "one  text"), (2, "another"), (1, "new text"), (8, "no id"), (3, "no\tid")], [], [(6, "one text"), (0, None), (4, "")]]
    for name, digest in (("sha", exact_dedup.sha256), ("poor", poor)):
        rows, seen = [], []
        for batch in batches:
            seen += [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in batch]
            frame_ = spark.createDataFrame(batch, "doc_id long, text string")
            found = exact_dedup.deduplicate(frame_, digest=digest, checkpoint=f"file://{tmp_path}/{name}").collect()
            assert len(found) == len(batch)
            for r in found:
                norm = re.sub(r"[\x20\x09-\x0D]+", " ", r["row"]["text"] or "")
                ids = [d for d, t in seen if t == norm]
                assert (r["keep_id"], r["group_size"], r["kept"]) == (min(ids, key=key), len(ids), r["row"]["doc_id"] == min(ids, key=key)), (name, r)
            rows += found
        assert len(rows) == len(seen)


def test_mixing(docs, awkward_rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = defaultdict(int)
    for _, t, _, s in awkward_rows:
        per[s] += size(t)
    names = sorted((s for s in per if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        level = (sum(per.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * per[s]}
        target |= {s: 3.0 * per[s] if over else level * weight[s] for s in (over or open_)}
        open_ -= over or open_
    found = mixing.mix(docs).collect()
    taken = defaultdict(int)
    for r in found:
        s = r["row"]["source"]
        assert (r["size"], r["source_size"]) == (size(r["row"]["text"]), per[s]) and abs(r["target"] - target[s]) < 1e-6
        assert 0 <= r["copies"] <= 3
        taken[s] += r["copies"] * r["size"]
    largest = defaultdict(int)
    for _, t, _, s in awkward_rows:
        largest[s] = max(largest[s], size(t))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    again = mixing.mix(docs.repartition(5)).collect()
    plain = lambda rows: Counter((r["row"]["doc_id"], r["row"]["text"], r["copies"]) for r in rows)
    assert plain(again) == plain(found)
    assert mixing.mixed_documents(docs).count() == sum(r["copies"] for r in found)


def test_sharding(docs):
    found = sharding.shard(docs).collect()
    slots, groups = defaultdict(list), defaultdict(set)
    for r in found:
        data = (r["row"]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        slots[r["shard"]].append(r["slot"])
        groups[data].add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in groups.values())


def test_lines(docs, awkward_rows):
    held = defaultdict(set)
    trim = lambda x: x.strip(" \t\n\x0b\x0c\r")
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in trim(x))
    for d, t, *_ in awkward_rows:
        for x in (t or "").split("\n"):
            if len(low(x)) >= 40:
                held[low(x)].add(d)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in held.items() if len(v) >= 5}
    assert last
    for r in line_dedup.deduplicate(docs).collect():
        lines = (r["row"]["text"] or "").split("\n")
        left = [x for x in lines if last.get(low(x), r["row"]["doc_id"]) == r["row"]["doc_id"]]
        assert (r["n_lines"], r["n_dropped"], r["kept_text"]) == (len(lines), len(lines) - len(left), "\n".join(left))


def test_language(docs):
    for r in language.identify(docs).collect():
        d, t = r["row"]["doc_id"], r["row"]["text"]
        assert r["held_out"] == (zlib.crc32(b"" if d is None else str(d).encode()) % 4 == 2)
        letters = any(c.isalpha() for c in t or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        if letters and r["row"]["lang"] and d is not None and d < 12:
            assert r["lang_pred"] == r["row"]["lang"]
        assert (r["bits"] is None) == (not letters)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}


def test_packing(docs, awkward_rows):
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = Counter(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for _, t, *_ in awkward_rows)
    whole, places = Counter(), defaultdict(list)
    pieces = packing.pack(docs.withColumn("one", F.monotonically_increasing_id())).collect()
    by_row = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u2").tolist()
        assert len(ids) == p["length"] > 0
        by_row[p["row"]["one"]].append((p["start"], ids))
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in by_row.values():
        joined = []
        for start, ids in sorted(parts):
            assert start == len(joined)
            joined += ids
        whole[tuple(joined)] += 1
    assert whole == texts
    sizes = []
    for q in sorted(places):
        end = 0
        for offset, length in sorted(places[q]):
            assert offset == end
            end += length
        sizes.append(end)
    assert sorted(places) == list(range(len(places))) and sizes[:-1] == [2048] * (len(sizes) - 1) and sizes[-1] <= 2048
    packed = {r["sequence_id"]: len(r["ids"]) // 2 for r in packing.sequences(packing.pack(docs)).collect()}
    assert sorted(packed.values()) == sorted(sizes)


def test_near_dedup(docs):
    found = near_dedup.classes(docs).collect()
    of = {}
    for r in found:
        of.setdefault(r["row"]["doc_id"], set()).add(r["class_id"])
    assert of[24] == of[25] == of[1] == {1} and of[26] == of[3] == {3} and of[5] == {5}
    assert all(of[i] == {i} for i in (0, 2, 4, 6, 7, 8, 9, 10, 11, 22, 23, 27, 28, 29))
    assert sum(r["kept"] for r in found) == len({(r["class_id"], r["class_size"], r["row"]["text"] if r["class_id"] is None else None) for r in found})


def test_pipeline(spark, docs, awkward_rows, tmp_path):
    now = docs
    for name, f in corpus_pipeline.STAGES:
        before = Counter((r["doc_id"], r["text"]) for r in now.select("doc_id", "text").collect()) if "text" in now.columns else None
        f(spark, now, "unused").write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert now.columns == SCHEMA.names
            after = Counter((r["doc_id"], r["text"]) for r in now.select("doc_id", "text").collect())
            assert set(after) <= set(before) and (name == "mixing" or all(after[k] <= before[k] for k in after))
            if name == "language":
                # without a letter, or like no language: 28 is one letter again and again, 30 mostly marks
                assert set(before) - set(after) == {(d, t) for d, t in before if not any(c.isalpha() for c in t or "") or d in (28, 30)}
            elif name == "exact_dedup":
                norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
                assert Counter(norm(t) for _, t in after.elements()) == Counter({norm(t) for _, t in before})
            elif name == "near_dedup":
                gone = {d for d, _ in before} - {d for d, _ in after}
                assert 26 in gone and gone <= {26, 40, 41, 42, 43, 44, 45}
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(now.columns)


def test_stages_of_many_partitions(spark, docs, tmp_path, monkeypatch):
    """Few rows that are dealt over many partitions are not written as that many tiny files, by no stage."""
    spread = docs.repartition(40)
    monkeypatch.setattr(corpus_pipeline, "_left", [])
    for name, f in corpus_pipeline.STAGES:
        with common.recorded() as paths:
            f(spark, spread, "unused").write.parquet(f"{tmp_path}/{name}")
        assert len(list((tmp_path / name).glob("part-*"))) <= common.FILES
        assert all(len(list(Path(x.removeprefix("file://")).glob("part-*"))) <= common.FILES for x in paths)


def test_pipeline_of_nothing(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
