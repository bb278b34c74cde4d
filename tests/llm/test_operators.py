"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import html_extract, pack, quality, shard, warc
from tarnflow.llm.embed_dedup import embedding_components
from tarnflow.llm.exact_dedup import exact_dedup
from tarnflow.llm.line_dedup import line_dedup
from tarnflow.llm.mix import mix_sources, mixed_documents
from tarnflow.llm.ngram_join import shingle_components

WHITE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()


def _texts():
    rng = np.random.default_rng(3)
    line = lambda n: " ".join(rng.choice(WORDS, n))
    base, shared, common = line(60), line(12), "A line that very many documents hold"
    out = [None, "", "one", "One  ", "two words", "\n\n", base, base.upper(), base.replace(" ", "\n"), base + " tail", f"{common}\n{line(20)}", line(9000)]
    for k in range(24):
        words = base.split()
        words[(k * 7) % 60] = f"edit{k}"
        out.append(" ".join(words))
        out.append(f"{line(15)}\n  {common.upper()}\t\n{shared}\n{line(15)}")
        out.append(line(int(rng.integers(1, 40))))
    return out + out[5:9]


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xyz"[i % 3] if i % 7 else None, "en", "clash", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, key string, n long").repartition(3)


def _rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def _roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_exact_dedup(docs):
    norm = ["".join(c for c in t or "" if c not in WHITE) for t in TEXTS]
    groups = defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append(i)
    got = _rows(exact_dedup(docs))
    for i, t in enumerate(norm):
        best = min(groups[t], key=lambda j: (-len(TEXTS[j] or ""), j))
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (best, len(groups[t]), best == i, hashlib.sha256(t.encode()).hexdigest())


def _cells(values, side):
    """Cells of values cut at the quantiles of their order, as the operator's sketch cuts small tables: exactly."""
    ordered = sorted(values)
    edges = {ordered[max(0, -(-i * len(ordered) // side) - 1)] for i in range(1, side)} - {ordered[-1]}
    return lambda x: sum(x > e for e in edges) * side // (len(edges) + 1)


@pytest.mark.parametrize("n, rank_rows", [(16, 20), (500, 20), (3, 100_000), (16, 3)])
def test_shards(docs, n, rank_rows):
    got = _rows(shard.hilbert_shards(docs, shards=n, rank_rows=rank_rows))
    sizes = Counter(r["shard"] for r in got.values())
    assert len(got) == len(TEXTS) and max(sizes.values()) - (min(sizes.values()) if len(sizes) == n else 0) <= 1
    slots = defaultdict(list)
    raw = [(t or "").encode() for t in TEXTS]
    source = [("xyz"[i % 3] if i % 7 else "").encode() for i in range(len(TEXTS))]
    of_size = _cells([len(x) + 1 for x in raw], 16)
    names = sorted({x or b"" for x in source})
    of_source = _cells(names, 16)
    for i, r in got.items():
        slots[r["shard"]].append(r["slot"])
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw[i]) + 1, zlib.crc32(raw[i]), "rows", None)
        assert r["curve"] == shard.hilbert_index((of_size(len(raw[i]) + 1), of_source(source[i]), 0), 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = sorted(got.values(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in order)
    # Copies in one cell stand together.
    seen, last = set(), None
    for r in order:
        key = (r["curve"], r["text_crc32"], r["size"])
        assert key == last or key not in seen
        seen.add(key)
        last = key
    again = _rows(shard.hilbert_shards(docs.repartition(7), shards=n, rank_rows=rank_rows))
    assert {i: (r["shard"], r["slot"]) for i, r in again.items()} == {i: (r["shard"], r["slot"]) for i, r in got.items()}


def test_shards_skip_files(spark, tmp_path):
    """Min/max statistics of the shards' files rule most of them out for a value of any dimension."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(9)
    rows = [(i, "x" * int(rng.lognormal(5, 1.2)), f"http://site-{int(rng.integers(40)):02}.org", str(rng.choice(["de", "en", "en", "en", "fr", "it"]))) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    placed = shard.hilbert_shards(df).select("doc_id", "shard", "size").join(df.drop("text"), "doc_id")
    placed.repartition(16, "shard").write.partitionBy("shard").parquet(str(tmp_path / "s"))
    stats = defaultdict(list)
    for file in (tmp_path / "s").rglob("*.parquet"):
        meta = pq.read_metadata(file)
        for c in range(meta.num_columns):
            column = meta.row_group(0).column(c)
            stats[column.path_in_schema].append((column.statistics.min, column.statistics.max))
    sizes = sorted(len(t) + 1 for _, t, _, _ in rows)
    for name, wanted in (("size", sizes[::100]), ("source", sorted({r[2] for r in rows})), ("lang", ["de", "fr", "it"])):
        read = np.mean([sum(lo <= x <= hi for lo, hi in stats[name]) for x in wanted]) / 16
        assert len(stats[name]) == 16 and read < 0.6


def test_hilbert_curve_is_continuous():
    side = 8
    place = {shard.hilbert_index((a, b, c), 3): (a, b, c) for a in range(side) for b in range(side) for c in range(side)}
    assert sorted(place) == list(range(side**3))
    assert all(sum(abs(x - y) for x, y in zip(place[i], place[i + 1])) == 1 for i in range(side**3 - 1))


def test_mix(docs):
    size = [len((t or "").split()) for t in TEXTS]
    own = defaultdict(int)
    src = {i: ("xyz"[i % 3] if i % 7 else None) for i in range(len(TEXTS))}
    for i, s in src.items():
        own[s] += size[i]
    names = sorted((s for s in own if s is not None)) + [None]
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, sum(size)
    target, free, left = {}, set(names), float(total)
    while True:  # clamp and share again until nothing is above
        heft = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / heft > 3 * own[s]]
        if not over:
            target |= {s: left * weight[s] / heft for s in free}
            break
        for s in over:
            target[s] = 3.0 * own[s]
            left -= target[s]
            free.discard(s)
    got = _rows(mix_sources(docs))
    taken = defaultdict(int)
    for i, r in got.items():
        assert r["size"] == size[i] and r["source_size"] == own[src[i]] and abs(r["target"] - target[src[i]]) < 1e-6 and 0 <= r["taken"] <= 3 * size[i]
        taken[src[i]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in names)
    assert {i: r["taken"] for i, r in _rows(mix_sources(docs.repartition(5))).items()} == {i: r["taken"] for i, r in got.items()}
    words = defaultdict(int)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
    assert all(words[i] == r["taken"] for i, r in got.items())


def _lines_kept(rows):
    """What line dedup leaves of (id, text) rows, by brute force."""
    held, keys = defaultdict(set), []
    for i, t in rows:
        keys.append([x.strip(WHITE).translate(LOWER) for x in (t or "").split("\n")])
        for k in keys[-1]:
            if len(k) >= 20 and i is not None:
                held[k].add(i)
    out = []
    for (i, t), own in zip(rows, keys):
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, own) if not (len(held[k]) >= 3 and i != max(held[k]))]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast_keys, max_bits", [(1000, 1 << 30), (0, 1 << 30), (0, 1 << 16)])
def test_line_dedup(docs, broadcast_keys, max_bits):
    got = line_dedup(docs, carry=("source", "key", "n"), broadcast_keys=broadcast_keys, max_bits=max_bits).collect()
    assert sorted(((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got), key=repr) == _lines_kept(list(enumerate(TEXTS)))
    assert any(r["n_dropped"] for r in got) and {r["key"] for r in got} == {"clash"} and all(r["n"] == r["doc_id"] for r in got)


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_line_dedup_of_hot_lines_and_repeated_ids(spark, broadcast_keys, monkeypatch):
    from tarnflow.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    hot, once = "A hot line that a third of all documents hold", "This line of Straße and ÄÖÜ is in few"
    rows = [(i, f"{hot if i % 3 == 0 else i}\n{once if i % 50 == 0 else ''}\nown line number {i} of all") for i in range(300)]
    rows += [(7, hot), (7, hot), (7, "two of the same id hold this line"), (7, "two of the same id hold this line"), (8, "two of the same id hold this line"), (None, hot), (None, "only nulls hold this long line"), (None, "only nulls hold this long line"), (None, "only nulls hold this long line")]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), broadcast_keys=broadcast_keys).collect()
    assert sorted(((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got), key=repr) == _lines_kept(rows)
    names = spark.createDataFrame([(None if i is None else f"{i:05}", t) for i, t in rows], "doc_id string, text string")
    assert sum(r["n_dropped"] for r in line_dedup(names).collect()) == sum(r["n_dropped"] for r in got)


def test_line_dedup_query_holds_few_long_texts_at_once(spark, tmp_path):
    """Every text arrives whole, but a batch on its way to Python is bounded by bytes, not by rows only."""
    from tarnflow.llm.line_dedup import op5_line_dedup

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    own = spark.newSession()  # what the query sets stays in it
    rows = [(i, f"A line that all of the long documents hold\n{i}" + f" word{i}" * 12_000) for i in range(300)]
    own.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_line_dedup(own, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, gone in _lines_kept(rows))
    held = [r["n"] for r in own.read.parquet(f"{tmp_path}/documents.parquet").select("text").mapInArrow(sizes, "n long").collect()]
    assert sum(held) > 20_000_000 and max(held) < 5_000_000
    assert int(own.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def test_shingles(docs):
    sets = []
    for t in TEXTS:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = _roots(range(len(sets)), links)
    got = _rows(shingle_components(docs, task_shingles=400))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    assert len(set(want.values())) < len(want) - 20


def test_ngram_join_of_copies_around_the_threshold(spark):
    rng = np.random.default_rng(11)
    texts = []
    for c in range(6):
        texts.append([f"w{c}x{i}" for i in range(90)])
        for k in range(40):  # of the first text or of any copy, up to a tenth edited or cut: many pairs link narrowly or just fail
            words = list(texts[-1 - int(rng.integers(0, k + 1))] if k % 2 else texts[-1 - k])
            for at in rng.integers(0, len(words), int(rng.integers(1, 4))):
                words[at] = f"e{c}x{k}x{at}"
            texts.append(words[: len(words) - int(rng.integers(0, 6))])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = _roots(range(len(sets)), links)
    assert 20 < len(set(want.values())) < 200
    got = _rows(shingle_components(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 24))
    for i in range(0, 200, 4):
        x[i + 1], x[i + 2] = x[i] * 2 + 0.2 * rng.standard_normal(24), x[i]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 24), (302, [float("nan")] + [1.0] * 23), (303, [None] + [1.0] * 23), (304, [1.0, 2.0]), (305, [])]
    rows += [(400 + i, [a * 1e200 for a in rows[i][1]]) for i in range(4)] + [(410 + i, [a * 1e-200 for a in rows[i][1]]) for i in range(4)]
    x = np.concatenate([x, x[:4], x[:4]])
    ids = [*range(300), *range(400, 404), *range(410, 414)]
    got = _rows(embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vec_id")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = {(ids[a], ids[b]) for a, b in zip(*np.nonzero(u @ u.T >= 0.9)) if a != b}
    want, counts = _roots([r[0] for r in rows], links), Counter(a for a, _ in links)
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (counts[i], want[i], want[i] == i) for i in want}


def test_pack(docs):
    from tokenizers import Tokenizer

    got = pack.pack(docs).collect()
    t = Tokenizer.from_file(pack.tokenizer_path())
    ids = [t.encode(x or "", add_special_tokens=False).ids + [0] for x in TEXTS]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert all(sum(r["length"] for r in by_doc[i]) == len(x) for i, x in enumerate(ids))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= 1.1 * sum(map(len, ids)) / 1024 + 1


def test_special_strings_are_encoded_as_the_tokenizer_does():
    e = pack.Encoder(pack.tokenizer_path())
    for x in ("<|endoftext|> x", "a  b\t\n c", "é　 d", ""):
        assert np.frombuffer(e.encode(x), dtype=np.uint32).tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids


def test_quality(spark):
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(WORDS, int(rng.integers(20, 200)))).capitalize() + "." for _ in range(150)]
    bad = [" ".join(rng.choice(WORDS, 40)).upper() + " !!" if k % 2 else "spam " * 50 for k in range(150)]
    rows = [(i, t, i, "clash", 2.0) for i, t in enumerate(good + bad)] + [(300, None, 1, "", 0.0), (301, "", 1, "", 0.0), (None, "x", 1, "", 0.0), (5, good[5], 1, "", 0.0), (302, "long " * 200_000, 1, "", 0.0)]
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (3, None), (3, 7)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, label long, features string, score double").repartition(3)
    got = quality.score_quality(docs, labels, carry=("label", "features")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert sorted((r["doc_id"] or -1, r["label"], r["features"]) for r in got) == sorted((r[0] or -1, r[2], r[3]) for r in rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert held and {r["doc_id"] for r in got if r["held_out"]} == {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == (r["doc_id"] < 150) for r in held]) > 0.95
    assert len({r["score"] for r in got if r["doc_id"] in (300, 301)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    again = quality.score_quality(docs.repartition(5), labels).collect()
    assert sorted((r["doc_id"] or -1, r["score"]) for r in again) == sorted((r["doc_id"] or -1, r["score"]) for r in got)
    # The sample is bounded, and a given quantile rejects that share of all rows.
    few = quality.training_texts(docs.select("doc_id", "text"), labels, 50).collect()
    assert len(few) == 50 == len({r["doc_id"] for r in few})
    half = quality.score_quality(docs, labels, max_training_rows=100, quantile=0.7).collect()
    assert abs(np.mean([r["predicted"] for r in half]) - 0.3) < 0.05
    none = quality.score_quality(docs, labels.where("quality = 1")).collect()
    assert {round(r["score"], 9) for r in none} == {0.7}


def test_quantiles_by_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(30):
        y = (rng.random(40) < 0.6).astype(int)
        s = np.round(y + rng.standard_normal(40), 1 + int(rng.integers(3)))
        q = quality.best_quantile(s, y)
        agree = lambda cut: (s[y == 1] > cut).sum() / max(1, (y == 1).sum()) + (s[y == 0] <= cut).sum() / max(1, (y == 0).sum())
        assert 0 <= q <= 1 and agree(quality.at_quantile(s, q)) >= max(agree(c) for c in [-9, *s]) - 0.15
        pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
        assert abs(quality.pair_accuracy(s, y) - np.mean(pairs)) < 1e-9
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    assert quality.bradley_terry(x, np.array([0, 0, 1, 1]))[0] > 0 > quality.bradley_terry(-x, np.array([0, 0, 1, 1]))[0]


PAGES = [
    ("http://a.org/1", "<html><head><title>T</title><script>x('</p>')</script></head><body><nav><a href=/>Menu</a></nav><div class='post-1'><h1>Head &amp; more</h1><p>First  para <b>graph</b>.<p>Second&nbsp;one</div><div id=comments><p>nonsense that is a good deal longer than the article itself, by far</p></div><footer>f</footer></body></html>", "Head & more\nFirst para graph.\nSecond one"),
    ("http://a.org/2", "<html><body><div class='post-2'><p>Only this text</p></div><div class=sidebar>Side</div></body></html>", "Only this text"),
    (None, "plain &lt;text&gt;", "plain <text>"),
    ("http://[bad", None, ""),
    ("http://b.org/", "", ""),
    ("http://b.org/x", "<script>never ends <p>no</p>", ""),
]


def test_pages(spark):
    rows = [(i, u, h, "clash") for i, (u, h, _) in enumerate(PAGES * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, paths string")
    for hosts in (0, 100):
        got = _rows(html_extract.extract_pages(pages, broadcast_hosts=hosts), "page_id")
        assert {i: r["text"] for i, r in got.items()} == {i: want for i, (_, _, want) in enumerate(PAGES * 2)}


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(PAGES)], "page_id long, url string, html string")
    responses = warc.responses_of_pages(pages)
    derived = warc.derivative_records(responses)
    source = {r["page_id"]: r for r in responses.collect()}
    rows = derived.collect()
    assert Counter(r["record_type"] for r in rows) == {"metadata": 6, "conversion": 6} and len({r["record_id"] for r in rows}) == 12
    for r in rows:
        s = source[r["page_id"]]
        assert (r["refers_to"], r["target_uri"], r["date"], r["payload_digest"]) == (s["record_id"], s["target_uri"], s["date"], s["payload_digest"])
        assert r["block_digest"] == warc.digest(bytes(r["block"])) and r["length"] == len(r["block"])
        if r["record_type"] == "metadata":
            assert b"source-header-content-type: text/html; charset=utf-8\r\n" in bytes(r["block"]) and s["block_digest"].encode() in bytes(r["block"])
        else:
            assert bytes(r["block"]).decode() == PAGES[r["page_id"]][2]
    warc.write_warc(derived, str(tmp_path / "w"))
    again = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert all({c: again[r["record_id"]][c] for c in warc.RECORD.names} == {c: r[c] for c in warc.RECORD.names} for r in rows)


def test_empty_tables(spark, docs):
    none = docs.where(F.lit(False))
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (exact_dedup(none), shard.hilbert_shards(none), mix_sources(none), line_dedup(none), shingle_components(none), pack.pack(none), quality.score_quality(none, labels), embedding_components(vectors), html_extract.extract_pages(pages), warc.derivative_records(warc.responses_of_pages(pages))):
        assert df.count() == 0


def _vectors_of(kind):
    rng = np.random.default_rng(7)
    if kind == "few dimensions":
        return rng.standard_normal((6000, 6)) @ rng.standard_normal((6, 64))
    far = rng.standard_normal((4000, 64))  # a third of all vectors lies around one, in few directions
    return np.concatenate([far, rng.standard_normal(64) + rng.standard_normal((2000, 5)) @ rng.standard_normal((5, 64)) * 0.3])


@pytest.mark.parametrize("kind, table", [("few dimensions", True), ("hot cluster", True), ("hot cluster", False)])
def test_embedding_links_are_complete(spark, kind, table, monkeypatch):
    """Recall is 1 by brute force, over many lists, blocks and chunks, with and without the table of distances between the centroids."""
    from tarnflow.llm import embed_dedup

    if not table:
        monkeypatch.setattr(embed_dedup, "MIN_LISTS", 8)
        monkeypatch.setattr(embed_dedup, "BLOCK", 300)
        monkeypatch.setattr(embed_dedup, "CHUNK", 700)
    x = _vectors_of(kind)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = _rows(embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)), "vec_id")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero(u @ u.T >= 0.9)
    a, b = a[a != b], b[a != b]
    assert len(a) > 1000
    n_links = np.bincount(a, minlength=len(x))
    want = _roots(range(len(x)), zip(a.tolist(), b.tolist()))
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (n_links[i], want[i]) for i in range(len(x))}


L, R = "Lead text. " * 40, "The rest of it. " * 40
WHOLE = [
    (f"<body><div class='lead'>{L}</div><div class='rest'>{R}</div></body>", [L, R]),
    (f"<body><div id=content><h1>Title</h1><div class=body><p>{R}</div></div></body>", ["Title", R]),
    (f"<body><div class=list><a href=/>Home</a></div><div class=story><p>{L}<table><tr><td>{R}{R}</td></tr></table><blockquote>{R}</blockquote></div><div>Last words</div></body>", [L, R + R, R, "Last words"]),
]


@pytest.mark.parametrize("page,want", WHOLE)
def test_no_text_of_a_page_is_lost(page, want):
    assert html_extract.text_of(page, None).split("\n") == [x.strip() for x in want]


def test_paths_of_a_host_lose_no_text(spark):
    narrow = f"<body><div class=body><p>{R}</div></body>"
    rows = [(i, "http://c.org/", narrow) for i in range(5)] + [(5 + i, "http://c.org/", p) for i, (p, _) in enumerate(WHOLE)]
    got = _rows(html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert all(got[5 + i]["text"].split("\n") == [x.strip() for x in want] for i, (_, want) in enumerate(WHOLE))


@pytest.mark.parametrize("attributes", ["class='post category-legal'", "id='content' class='reviews'", "class='tags'"])
def test_hint_words_around_most_of_the_text(attributes):
    page = f"<body><nav>menu</nav><div {attributes}><p>{L}</p><p>{R}</p><div class=social>Share</div></div><div>A line.</div></body>"
    assert html_extract.text_of(page, None).split("\n") == [L.strip(), R.strip(), "A line."]


def test_hint_words_around_all_text():
    assert html_extract.text_of(f"<body><nav>menu</nav><div id=comments><p>{L}</p></div></body>", None) == L.strip()


def test_mix_of_empty_and_cut_documents(spark):
    rows = [(i, "a b\n c\td\n\ne f", "x") for i in range(5)] + [(5, "", "x"), (6, None, "x"), (7, " \n", "x")] + [(8 + i, "g h", "y") for i in range(50)]
    texts = {r[0]: r[1] for r in rows}
    got = mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    copies = Counter(r["doc_id"] for r in got)
    assert all(1 <= copies[i] <= 3 for i in (5, 6, 7))
    assert all(r["text"] == texts[r["doc_id"]] or texts[r["doc_id"]].startswith(r["text"]) for r in got)


def test_mix_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c d", "x")] * 40 + [(None, "e f", "x")] * 30 + [(i, "g " * 20, "y") for i in range(2, 30)] + [(2, "again with this id", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = {r["source"]: r["taken"] for r in mix_sources(df).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    got = mixed_documents(df).collect()
    words = Counter()
    for r in got:
        words[r["source"]] += len(r["text"].split())
    assert all(abs(words[s] - want[s]) <= 40 for s in want)
    copies = Counter((r["doc_id"], r["text"]) for r in got if r["text"] in ("a b c d", "e f"))
    assert copies[1, "a b c d"] <= 120 and copies[None, "e f"] <= 90


def test_differing_bits_never_exceed_differing_ngrams():
    from tarnflow.llm.ngram_join import BITS, _parity

    rng = np.random.default_rng(5)
    for size in (0, 1, 30, 500, 20_000):
        pool = rng.integers(0, 1 << 63, size=size + size // 3, dtype=np.uint64)
        a, b = np.unique(pool[:size]), np.unique(pool[size // 3 :])
        bits = np.bitwise_count((_parity(a) ^ _parity(b)).view(np.uint64)).sum()
        assert len(_parity(a)) == BITS // 64 and bits <= len(np.setxor1d(a, b))
        assert not (_parity(a) ^ _parity(a[::-1])).any()
