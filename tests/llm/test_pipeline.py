"""The stages of corpus_pipeline one by one against brute force, and the whole on a small folder of tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tarnflow.llm import pack, quality
from test_operators import WORDS, _lines_kept, _roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, label string"


def _documents():
    rng = np.random.default_rng(8)
    line = lambda n: " ".join(rng.choice(WORDS, n)).capitalize() + "."
    base, common = line(80), "A line that many of the documents here hold"
    texts = [None, "", " \n\t", base, base, base + " Tail", "One", "long " * 30_000]
    for k in range(60):
        words = base.split()
        words[(k * 5) % 70] = f"edit{k}"
        texts += [" ".join(words), f"{line(30)}\n{common}\n{line(25)}", line(int(rng.integers(5, 120))), "spam " * 40 if k % 2 else line(20).upper() + " !!! $$$"]
    ids = list(range(len(texts)))
    for k in (30, 31, 40):
        ids[k] = None
    ids[50] = ids[51] = 52
    return [(i, t, "en", "xyz"[k % 3] if k % 5 else None, -1, "clash", k, "clash") for k, (i, t) in enumerate(zip(ids, texts))]


ROWS = _documents()
LABELS = [(r[0], int(not ((r[1] or "").startswith("spam") or (r[1] or "").isupper() or "!!!" in (r[1] or "")))) for r in ROWS if r[0] is not None and r[6] % 3]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(LABELS, "doc_id long, quality int").write.parquet(str(path / "labels.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def _plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quality_drops_rows_not_ids(spark, documents, folder):
    got = cp.quality(spark, documents, folder)
    assert got.schema.simpleString() == documents.schema.simpleString()
    model = quality.fit(documents.where("doc_id IS NOT NULL AND pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) <> 2").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), spark.read.parquet(f"{folder}/labels.parquet"), 20_000)
    score = lambda t: model.raw(np.array([quality.features(t or "")]))[0]
    margin = {r[6]: score(r[1]) - model.cut for r in ROWS}
    kept = {r["n"] for r in got.collect()}
    assert all((k in kept) == (m > 0) for k, m in margin.items() if abs(m) > 1e-9)
    assert got.count() == len(kept) and 40 < len(kept) < len(ROWS) - 40


def test_lines_match_brute_force(spark, documents, folder):
    got = cp.lines(spark, documents, folder)
    assert got.schema.simpleString() == documents.schema.simpleString()
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == [(i, t) for i, t, _, _ in _lines_kept([(r[0], r[1]) for r in ROWS])]
    assert all(r["n_chars"] == len(r["text"]) and r["key"] == "clash" for r in got.collect())


def _near(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return _roots(range(len(sets)), links)


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_near_copies_leave_one_row_a_group(spark, documents, folder, broadcast_rows, monkeypatch):
    monkeypatch.setattr(cp, "BROADCAST_ROWS", broadcast_rows)
    got = cp.near_copies(spark, documents, folder)
    assert got.columns == documents.columns
    root = _near(ROWS)
    kept = [r["n"] for r in got.collect()]
    assert Counter(root[k] for k in kept) == Counter(set(root.values()))
    # Ids that tell rows apart: the smallest of each group stays.
    unique = documents.withColumn("doc_id", F.col("n").cast("long"))
    groups = defaultdict(list)
    for k, r in root.items():
        groups[r].append(k)
    assert sorted(r["n"] for r in cp.near_copies(spark, unique, folder).collect()) == sorted(min(g) for g in groups.values())


def test_mix_meets_targets(spark, documents, folder):
    got = cp.mix(spark, documents, folder)
    assert got.columns == documents.columns
    size, taken = Counter(), Counter()
    for r in ROWS:
        size[r[3]] += len((r[1] or "").split())
    for r in got.collect():
        taken[r["source"]] += len((r["text"] or "").split())
    order = sorted(s for s in size if s is not None) + [None]
    weight, left, free, target = dict(zip(order, (5, 2, 1, 5))), float(sum(size.values())), set(order), {}
    while free:
        over = [s for s in free if left * weight[s] / sum(weight[f] for f in free) > 3 * size[s]]
        settled = over or list(free)
        share = left / sum(weight[f] for f in free)
        for s in settled:
            target[s] = 3 * size[s] if over else share * weight[s]
        for s in settled:
            free.discard(s)
            left -= target[s]
    assert all(abs(taken[s] - target[s]) <= 2 for s in order)
    copies = Counter((r["doc_id"], r["n"]) for r in got.collect())
    assert max(copies.values()) <= 3


def test_packing_holds_every_token(spark, documents, folder):
    encoder = pack.Encoder(pack.tokenizer_path())
    want = Counter()
    for r in ROWS:
        ids = encoder.encode(r[1] or "") + bytes(4)
        for at in range(0, len(ids), 4096):
            want[r[0], at // 4, zlib.crc32(ids[at : at + 4096])] += 1
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in cp.sequences(spark, documents, folder).collect()) == want


def test_whole_pipeline_in_order(spark, folder, documents, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["quality", "line dedup", "near copies", "mix", "packing"]
    assert cp.run(spark, folder).count() > 0  # null and repeated ids
    # Ids that tell rows apart: every run agrees.
    documents.withColumn("doc_id", F.col("n").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in cp.STAGES[:2]:
        docs = stage(spark, docs, str(tmp_path))
    rows = [tuple(r) for r in docs.collect()]
    root = _near(rows)
    docs = cp.near_copies(spark, docs, str(tmp_path))
    assert docs.count() == len(set(root.values())) < len(rows)
    for _, stage in cp.STAGES[3:]:
        docs = stage(spark, docs, str(tmp_path))
    assert _plain(cp.run(spark, str(tmp_path)).select("doc_id", "start", "ids_crc32", "doc_tokens")) == _plain(docs.select("doc_id", "start", "ids_crc32", "doc_tokens"))


def test_empty_documents(spark, documents, tmp_path):
    documents.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
