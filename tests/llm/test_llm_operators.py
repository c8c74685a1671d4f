"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import chat, decontaminate, mixing, secrets, sharding, simhash, substrings, topk, toxicity, url_rules
from seqloom.llm.components import components

WORDS = [a + b for a in ("ba", "ko", "li", "mu", "ter", "von") for b in ("na", "sto", "ri", "pel", "du")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, "  \t\n "), (3, "one"), (4, "One two"), (5, "one  two"), (6, "ß é Ünï  x"), (7, sentence(rng, 20_000))]
    base = [sentence(rng, 60) for _ in range(8)]
    for i in range(8, 60):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(60, rows[8][1]), (61, rows[9][1]), (61, rows[9][1]), (None, rows[10][1]), (62, base[0] + " " + base[1]), (63, sentence(rng, 3) + " " + base[2][40:300])]
    return rows


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def sf_dir(spark, texts, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, ["en", "de", None][k % 3], ["src0", "src0", "src7", None][k % 4], "clash") for k, (i, t) in enumerate(texts)]
    frame(spark, docs, "doc_id long, text string, lang string, source string, shard string").write.parquet(f"{d}/documents.parquet")
    frame(spark, [(i, int(i % 2 == 0), 1) for i in range(8, 40)], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    item = texts[8][1]
    frame(spark, [(1, item), (2, None), (3, "too short")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    frame(spark, [(1, "http://A.org/x", ""), (1, "http://A.org/x", ""), (2, None, ""), (3, "no scheme", "")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    frame(spark, [], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    frame(spark, [], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    return d


def test_empty_tables(spark, empty_dir):
    from seqloom.llm.registry import queries

    for name, query in queries().items():
        assert query(spark, empty_dir).count() == (name == "op7_chat_format"), name


def test_sharding(spark, sf_dir, texts):
    rows = sharding.op1_rendezvous_sharding(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    weighted = spark.range(20_000).withColumn("s", sharding.rendezvous(F.col("id"), [1.0, 3.0])).groupBy("s").count().collect()
    assert abs(dict((r.s, r["count"]) for r in weighted)[1] / 20_000 - 0.75) < 0.02


def test_url_rules(spark):
    urls = ["http://a.EXAMPLE.org/es/x", "https://example.org/en/19?q=/de/", "http://x.com/de/1", "http://x.com/fr", "http://com/fr/", "http://notexample.org/es/", "http://x.net/a/login/b", "ftp://org", None, "x", "http://EXAMPLE.ORG/ES/", "://org/", "http://x.com/fr/#f", "http://x.com?u=/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for most in (1, 3, 50_000):
        got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_rules.judge_urls(pages, url_rules.SITE_RULES + url_rules.METHOD_RULES, max_rules=most).collect()}
        for i, url in enumerate(urls):
            host, path = url_rules.split_url(url)
            fit = [r for r in url_rules.SITE_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
            best = max(fit, key=lambda r: len(r.pattern), default=None)
            assert got[i][:2] == (host, best and best.pattern), url
            assert got[i][2] == (best.verdict if best else "block" if "/login/" in path else "allow")


def test_url_rules_run_only_what_tokens_fetch(spark):
    """A url runs the expressions of the rules that its tokens fetch, and no other."""
    rules = url_rules.SITE_RULES + url_rules.METHOD_RULES
    free = [r for r in rules if not r.tokens()]
    urls = ["http://qqq.zz/www", "http://example.org/es/" + "x" * 100_000, "http://x.net/a/login/b", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judge_urls(pages, rules).collect()}
    counts = url_rules.token_counts(pages.select("url"), rules)
    by, _ = url_rules.build_index(rules, counts)
    for i, url in enumerate(urls):
        fetched = sum(len(by.get(t, ())) for t in url_rules.url_tokens(*url_rules.split_url(url)))
        assert got[i].candidates == fetched + len(free) and got[i].regex_runs <= got[i].candidates
    assert got[0].regex_runs <= len(free) and max(r.candidates for r in got.values()) < len(rules) / 2
    assert got[1].verdict == "block" and got[1].rule == "example.org/es/"


def test_secrets_of_a_text_of_many(spark):
    text = "\n".join(f"token: abc{i:06d} {'%040x' % (i * 7919)}" for i in range(3000))
    r = secrets.scan_secrets(spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string"), "doc_id", F.col("source"), F.col("source")).first()
    assert (r.n_assign, r.n_hex) == (3000, 3000)
    spans = [s.split(":") for s in r.spans.split(",")]
    assert [text[int(a) : int(b)] for k, a, b in spans if k == "hex"] == ["%040x" % (i * 7919) for i in range(3000)]


def test_topk(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-40, 40, size=(400, 8))
    x[50:200] = x[50]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, _v array<long>")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("_v").alias("_q"))
    got = defaultdict(list)
    for r in topk.top_k(queries, vectors, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 400, 50):
        want = sorted(((-int(x[q] @ x[i]), i) for i in range(400) if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in want]
    odd = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [0.5, -0.0005])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r._v) for r in topk.integer_vectors(odd).collect()] == [(5, [512, -1])]


def test_topk_reads_and_resolves_few():
    """On vectors in all directions, the worst case: entries read and pairs resolved stay well below all, and results are exact."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    x[100:130] = x[100]  # ties, in several runs as they are dealt below
    deal = rng.permutation(4000)
    block = topk.QueryBlock(np.arange(0, 4000, 100), x[::100], 10)
    for at in range(0, 4000, topk.RUN):
        rows = deal[at : at + topk.RUN]
        block.search(topk.SortedRun(rows, x[rows], np.argsort(x[rows], axis=0, kind="stable")))
    for i, q in enumerate(block.ids):
        scores = x @ x[q]
        want = [(int(scores[j]), int(j)) for j in np.lexsort((np.arange(4000), -scores)) if j != q][:10]
        assert list(zip(*(b.tolist() for b in block.best[i]), strict=True)) == want
    assert block.read < 0.6 * block.entries and block.resolved < 0.25 * block.pairs
    late = topk.QueryBlock(block.ids, block.values, 10, block.bound.copy())  # with a good bound from the beginning, as later tasks have
    for at in range(0, 4000, topk.RUN):
        rows = deal[at : at + topk.RUN]
        late.search(topk.SortedRun(rows, x[rows], np.argsort(x[rows], axis=0, kind="stable")))
    assert late.resolved < 0.15 * late.pairs and late.read < block.read


def test_topk_over_many_runs_and_tasks(spark, monkeypatch):
    for name, value in (("RUN", 16), ("QUERIES", 4), ("SEED_RUNS", 2), ("TASK_RUNS", 3)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    x = rng.integers(-9, 9, size=(300, 6))
    x[rng.integers(0, 300, 90)] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(299, x[299].tolist()), (5000, [1, 2]), (5001, [2**40, -(2**40)])]
    vectors = spark.createDataFrame(rows, "vec_id long, _v array<long>")
    queries = vectors.filter("vec_id % 20 = 0 OR vec_id = 5001").select(F.col("vec_id").alias("query_id"), F.col("_v").alias("_q"))
    got = defaultdict(list)
    for r in topk.top_k(queries, vectors, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = {}
    for q, v in {i: v for i, v in rows if i % 20 == 0 or i == 5001}.items():
        want[q] = [(i, -s) for s, i in sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))[:7]]
    assert got == want


def test_secrets(spark):
    key = "AKIA" + "Q" * 18
    rows = [(1, f'password = "hunter22" {key}é', "a"), (2, f"TOKEN:'{'ab' * 12}' secret=token:abcdef", "a"), (3, None, "b"), (4, f"é\U0001f600 {key} x", "b"), (5, f"{key}", "c"), (6, "passwd=short token=12345", None), (6, "passwd=short token=12345", None), (7, "A1b2" * 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r for r in secrets.scan_secrets(docs, "doc_id", F.col("source"), F.col("source")).orderBy("doc_id").collect()]
    patterns = {"assign": (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), "access": (r"AKIA[A-Z0-9]+", 0), "hex": (r"[0-9a-f]+", 0)}
    for r, (_, text, _) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        spans = []
        for k, (kind, (p, flags)) in enumerate(patterns.items()):
            for m in re.finditer(p, text or "", flags):
                if {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}[kind](m):
                    spans.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        base = ",".join(s for _, _, s in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert {r.doc_id: r.n_copied for r in got}[5] == 1 and "mixed:0:28" in got[-1].spans


def test_chat(spark):
    bad = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "system", None), (1, 1, "us:er", bad), (1, 2, "assistant", bad + "###</turn"), (None, 5, None, "x"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a")]
    got = defaultdict(list)
    for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("place").collect():
        got[r.conv_id].append(r)
    assert chat.read_back("".join(r.output for r in got[1])) == [("system", ""), ("us:er", bad), ("assistant", bad + "###</turn")]
    a = got[1][2]
    assert chat.unescape(a.output[a.loss_start : a.loss_end]) == bad + "###</turn" and len(got[2]) == 2 and got[None][0].role == ""
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["\\", "#", "###", "</turn>", "<", "/turn>", "h", "l", ":", "\n", "é"]) for _ in range(12))
        assert chat.unescape(chat.escape(text)) == text and chat.read_back(chat.marked_turns([(text, text)])) == [(text, text)]
    long = [("user", str(i)) for i in range(100)]
    assert "".join(p.output for p in chat.render_incrementally(long)) == chat.marked_turns(long)
    rewriting = lambda turns: "".join(f"[{t}]" for _, t in turns[-1:])
    assert [p.rewrote for p in chat.render_incrementally([("u", "a"), ("u", "b")], rewriting)] == [False, True]


def test_chat_renders_whole_prefixes():
    turns = [("u" if i % 2 else "assistant", f"t{i}") for i in range(80)]
    numbered = lambda turns: "".join(f"{i}:{'first' if not i else role}:{t}\n" for i, (role, t) in enumerate(turns))
    assert "".join(p.output for p in chat.render_incrementally(turns, numbered)) == numbered(turns)
    dropping = lambda turns: "".join(f"[{t}]" for i, (_, t) in enumerate(turns) if i or len(turns) <= 50)
    assert [i for i, p in enumerate(chat.render_incrementally(turns, dropping)) if p.rewrote] == [50]
    seen = []

    def pairs(turns):
        seen.append(len(turns))
        return "".join(f"[{a[1]}>{b[1]}]" for a, b in zip([("", ""), *turns], turns, strict=False))

    pairs.look_back = 1
    assert "".join(p.output for p in chat.render_incrementally(turns, pairs)) == pairs(turns) and max(seen[:-1]) <= chat.CHUNK + 1


def contract_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash(spark, sf_dir, texts):
    prints = [contract_print(t) for _, t in texts]
    up = list(range(len(texts)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i, (d, _) in enumerate(texts):
        groups[root(i)].append(d)
    want = Counter((d, f"{prints[i]:016x}", min((x for x in groups[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(texts))
    assert Counter(tuple(r) for r in simhash.op8_simhash_dedup(spark, sf_dir).collect()) == want


@pytest.mark.parametrize(("words", "radius"), [(1, 3), (1, 0), (1, 1), (2, 34), (1, 6)])
def test_bit_slices(words, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, size=(20, words)).astype(np.uint64)
    prints = base[rng.integers(0, 20, 300)]
    for _ in range(4):
        prints = np.where(rng.random(prints.shape) < 0.5, prints ^ (np.uint64(1) << rng.integers(0, 64, prints.shape).astype(np.uint64)), prints)
    far = np.bitwise_count(prints[:, None] ^ prints[None]).sum(-1)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if far[i, j] <= radius}
    assert {(i, int(j)) for i, js in simhash.block_links(prints, radius) for j in js} == want
    group = np.sort(rng.integers(0, 25, 300))
    i, j = simhash.small_links(prints, group, radius)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in want if group[a] == group[b]}
    if words == 1 and radius:
        masks = simhash.pigeonhole_masks(64, radius)
        assert all(any((int(prints[a, 0]) ^ int(prints[b, 0])) & m[0] == 0 for m in masks) for a, b in want)


def test_hot_bucket_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    ids = [(i, (1 << (i % 60)) | (1 << (i // 60))) for i in range(200)]
    nodes = spark.createDataFrame([(i, p) for i, p in ids], "node long, _print long").dropDuplicates(["_print"])
    found = components(simhash.hamming_links(nodes, ["_print"], 3, simhash.mask_keys(["_print"], simhash.pigeonhole_masks())))
    kept = [r.node for r in nodes.collect()]
    assert {r.root for r in found.collect()} == {min(kept)} and found.count() == len(kept)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (50, 60)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 60: 50}


#: One filter; a filter each for several passes; occurrences and texts joined; and salted digests with either.
PATHS = [{}, {"most_shared": 40, "most_passes": 1000}, {"most_shared": 1, "most_passes": 1}, {"hot_docs": 1}, {"hot_docs": 1, "most_shared": 1, "most_passes": 1}]


@pytest.mark.parametrize("path", PATHS)
def test_substrings(spark, texts, path):
    first = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in texts]
    for d, w in split:
        for k in range(len(w) - 12):
            if d is not None:
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, d), d)
    want = Counter()
    for d, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if d is not None and first[tuple(w[k : k + 13])] < d:
                gone[k : k + 13] = [True] * 13
        want[d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()] += 1
    got = substrings.remove_repeats(frame(spark, texts).withColumn("text", F.coalesce("text", F.lit(""))), **path)
    assert Counter(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("path", PATHS[::2])
def test_substrings_whatever_stands_between_words(spark, path):
    rng = random.Random(11)
    passages = [sentence(rng, rng.randrange(13, 40)).split() for _ in range(12)]
    rows = []
    for i in range(48):
        between = [" ", "  ", "\r\n", "\n\n", "\t", "\n        "]
        passage = passages[i % 12]
        rows.append((i, sentence(rng, 5) + "  " + "".join(w + (between[(i // 12) % 2] if i < 24 else rng.choice(between)) for w in passage) + sentence(rng, 5)))
    first, split = {}, [(d, t.split()) for d, t in rows]
    for d, w in split:
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), d)
    want = {}
    for d, w in split:
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < d for p in range(k, k + 13)}
        want[d] = len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert sum(n > 0 for n, _ in want.values()) == 36
    got = substrings.remove_repeats(frame(spark, rows), **path).collect()
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in got} == want


def test_index_runs_merge(spark, tmp_path):
    index = substrings.FingerprintIndex(spark, fanout=2)
    rng = random.Random(5)
    passage = sentence(rng, 30)
    batch = lambda *rows: frame(spark, list(rows))
    assert index.add(batch((1, passage), (2, sentence(rng, 30)))).count() == 0
    assert index.add(batch((3, sentence(rng, 9) + " " + passage))).count() > 0
    assert [level for level, _ in index.runs] == [0, 0] and index.add(batch((4, passage))).count() > 0
    assert [level for level, _ in index.runs] == [1, 0]
    assert index.add(batch((5, sentence(rng, 30)))).count() == 0 and [level for level, _ in index.runs] == [1, 0, 0]
    assert index.add(batch((6, passage + " " + passage))).count() > 0 and [level for level, _ in index.runs] == [2, 0]
    assert index.add(batch((7, passage))).count() > 0 and [level for level, _ in index.runs] == [2, 0, 0]
    assert index.add(batch((8, passage))).count() > 0 and [level for level, _ in index.runs] == [2, 1, 0]
    index.drop()


def test_index_outlives_a_call(spark, texts, tmp_path):
    """Batches that come one after another, with an index on disk that is opened again, are judged as all rows at once."""
    rows = [(d, t or "") for d, t in texts if d is not None]
    want = Counter(tuple(r) for r in substrings.remove_repeats(frame(spark, rows)).collect())
    got, history = Counter(), None
    for lo, hi in ((0, 25), (25, 41), (41, 70)):
        index = substrings.FingerprintIndex(spark, root=str(tmp_path / "index"))
        new = frame(spark, [r for r in rows if lo <= r[0] < hi])
        got += Counter(tuple(r) for r in substrings.remove_repeats(new, batches=1, index=index, history=history).collect())
        history = new if history is None else history.unionByName(new)
        for _, name in index.runs:
            spark.sql(f"DROP TABLE {name}")  # as in another session; the files stay
    assert got == want


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = sentence(rng, 30).split() + (["scumbag", "fool"] if toxic else ["friend"])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(9000, None), (9001, ""), (9002, "fool " * 5000)]
    docs, known = frame(spark, rows), spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    machine = toxicity.fit_toxicity(docs, known, rows=400)
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs, machine).collect()}
    hits = [(got[i] >= 0.5) == bool(t) for i, t in labels]
    assert sum(hits) / len(hits) > 0.98 and got[9000] < 0.5 and got[9001] == got[9000] and got[9002] > 0.5
    assert {r.doc_id for r in toxicity.reject_toxic(docs, machine).collect()} >= {9000, 9001}


def test_toxicity_learns_pairs():
    rng = np.random.default_rng(0)
    a, b = rng.random(800) < 0.5, rng.random(800) < 0.5
    label = (a & b).astype(float)
    doc = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)])
    term = np.concatenate([np.full(a.sum(), 7), np.full(b.sum(), 9)]).astype(np.uint32)
    m = toxicity.fit_machine(doc, term, label)
    order = np.argsort(doc, kind="stable")
    place = np.searchsorted(m.terms, term[order])
    assert (((m.logits(doc[order], place, 800)) > 0) == (label > 0)).mean() > 0.99


def test_toxicity_learns_pairs_that_say_nothing_alone():
    rng = np.random.default_rng(1)
    has = rng.random((1200, 40)) < 0.5
    label = (has[:, 3] ^ has[:, 17]).astype(float)
    doc, term = np.nonzero(has)
    m = toxicity.fit_machine(doc, (term * 1000).astype(np.uint32), label)
    assert {3000, 17000} <= set(m.terms.tolist())
    known = np.isin(term * 1000, m.terms)
    logits = m.logits(doc[known], np.searchsorted(m.terms, (term * 1000).astype(np.uint32)[known]), 1200)
    assert ((logits > 0) == (label > 0)).mean() > 0.95


def test_toxicity_sums_over_pairs():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(np.arange(20, dtype=np.uint32), 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    sets = [sorted(rng.choice(20, n, replace=False).tolist()) for n in (0, 1, 2, 7, 20)]
    doc = np.concatenate([np.full(len(s), i) for i, s in enumerate(sets)]).astype(int)
    got = m.logits(doc, np.concatenate(sets).astype(int), len(sets))
    want = [0.3 + sum(m.weights[a] for a in s) + sum(m.vectors[a] @ m.vectors[b] for k, a in enumerate(s) for b in s[:k]) for s in sets]
    assert np.allclose(got, want)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test data")
def test_toxicity_on_labels_it_has_not_seen(spark):
    """Of 97 held-out toxic texts six hold no term that any labelled toxic text has (they are spam or licenses); nine of ten must be found."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.op9_fm_toxicity(spark, d).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r for r in got if r.toxic == 1]
    assert len(toxic) > 50 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in got if r.toxic == 0) <= 0.01 * len(got)


def test_toxicity_ignores_held_out_labels(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, 20) + (" scum" if i % 4 == 0 else "")) for i in range(300)]
    docs, base = frame(spark, rows), [(i, int(i % 4 == 0)) for i, _ in rows]
    hidden = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    told = [spark.createDataFrame(x, "doc_id long, toxic int") for x in (base, [(i, 1 - t if i in hidden else t) for i, t in base])]
    one, two = (toxicity.fit_toxicity(docs, t) for t in told)
    probe = pa.array([t for _, t in rows])
    assert np.array_equal(one.scores(probe), two.scores(probe)) and len(hidden) > 30


def test_decontamination(spark):
    item = "If Alice buys 12 apples at 3 km from the market and Bob sells 7 pears, how many fruits do they carry home together?"
    again = "we saw: If Carol buys 40 apples at 9 km from the market and Dave sells 8 pears, how many fruits do they carry home together? end"
    mixed = again.replace("Dave", "Carol")
    rows = [(1, item), (2, again), (3, mixed), (4, None), (5, ""), (6, "totally other words " * 30), (7, "x " * 3000 + item)]
    items = spark.createDataFrame([(10, item), (11, None), (12, "short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.verbatim) for r in decontaminate.find_leaks(frame(spark, rows), items).collect()}
    assert got == {(1, 10, True), (2, 10, False), (7, 10, True)}
    assert {r.doc_id for r in decontaminate.drop_leaks(frame(spark, rows), items).collect()} == {3, 4, 5, 6}
    assert decontaminate.find_leaks(frame(spark, rows), items.limit(0)).count() == 0


def test_decontamination_of_edited_passages(spark):
    rng = random.Random(4)
    a, b, c = (sentence(rng, 20) for _ in range(3))
    item = f"{a} on Monday {b} on Monday {c}"
    edited = f"{a} on Monday {b} on Tuesday {c}"
    rows = [(1, "so " + edited), (2, edited.replace("Tuesday", "Friday")), (3, f"{a} on Tuesday {b} on Tuesday {c}"), (4, " ".join(a.split()[-5:]) + " on Monday and " + c[:20])]
    items = spark.createDataFrame([(10, item)], "item_id long, text string")
    got = {(r.doc_id, r.doc_word, r.item_word, r.n_words, r.verbatim) for r in decontaminate.find_leaks(frame(spark, rows), items).collect()}
    assert got == {(1, 1, 0, 43, True), (1, 45, 44, 20, True), (2, 0, 0, 43, True), (2, 44, 44, 20, True), (3, 0, 0, 64, False)}
    assert {r.doc_id for r in decontaminate.drop_leaks(frame(spark, rows), items).collect()} == {4}


def test_decontamination_of_slots_and_letter_case(spark):
    prose = "am Montag fährt Jürgen über die Straße nach Köln und kauft dort Äpfel für seine Tante Änne aus Österreich"
    title = "The Old Man And The Sea By The River Of The Long Lost Northern Kingdom Of Snow"
    names = "Alice, Bob, Carol, Dave, Erin, Frank, Grace, Heidi, Ivan, Judy, Mallory, Niaj, Olivia, Peggy"
    sums = "3 + 4 = 7 ; 12 * 5 = 60 ; 90 - 41 = 49 ; 8 / 2 = 4"
    items = list(enumerate([prose, title, names, sums]))
    copies = {(10 * i + k, i): c for i, t in items for k, c in enumerate((t, t.upper(), t.lower(), f"before that {t.upper()} and after"))}
    rows = [(d, t) for (d, _), t in copies.items()] + [(98, " ".join(reversed(names.split())))]
    leaks = decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in leaks if r.verbatim} == set(copies) == {(r.doc_id, r.item_id) for r in leaks}
    assert {r.n_words for r in leaks if r.item_id == 0} == {len(prose.split())}


def plain_canonical(text):
    """Words of a text and their kinds, one word at a time."""
    units = set(decontaminate.UNITS)
    out, before, start, line = [], "", True, True
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        begins = start or before[-1:] in (".", "!", "?", ":") or "\n" in text[at_end : m.start()]
        word = m[0]
        while len(word) > 1 and ord(word[0]) < 128 and not word[0].isalnum() and word[0] not in "%$":
            word = word[1:]
        while len(word) > 1 and ord(word[-1]) < 128 and not word[-1].isalnum() and word[-1] not in "%$":
            word = word[:-1]
        literal = word.lower()
        capitals, digits = sum("A" <= c <= "Z" for c in word), sum("0" <= c <= "9" for c in word)
        kind = "name" if ("A" <= word[0] <= "Z" and not begins) or (capitals == len(word) > 1) else "word"
        kind = "num" if 2 * digits >= len(word.encode()) else kind
        if out and out[-1][1] == "num" and literal in units:
            kind = "unit"
        out.append((literal, kind))
        before, start, at_end = m[0], False, m.end()
    return out


def plain_leaks(text, item):
    """Whether a text holds a verbatim window, or a run of template windows with consistent slots, of an item."""
    a, b = plain_canonical(item), plain_canonical(text)
    if len(a) < decontaminate.SHORTEST:
        return False
    n = min(13, len(a))
    template = lambda w: tuple(x if k == "word" else k for x, k in w)
    if any([x for x, _ in a[i : i + n]] == [x for x, _ in b[j : j + n]] for i in range(len(a) - n + 1) for j in range(len(b) - n + 1)):
        return True
    for shift in range(-len(a), len(b)) if n == 13 else ():
        hit = [i for i in range(len(a) - 12) if 0 <= i + shift <= len(b) - 13 and template(a[i : i + 13]) == template(b[i + shift : i + shift + 13]) and sum(k == "word" for _, k in a[i : i + 13]) >= 7]
        for run in np.split(np.array(hit), np.flatnonzero(np.diff(hit) > 1) + 1) if hit else ():
            pairs = [(a[p], b[p + shift]) for p in range(run[0], run[-1] + 13) if a[p][1] != "word"]
            for kind in ("num", "name", "unit"):
                of = {(x, y) for (x, k), (y, _) in pairs if k == kind}
                if len(of) != len({x for x, _ in of}) or len(of) != len({y for _, y in of}):
                    break
            else:
                return True
    return False


@pytest.mark.parametrize("most", [None, 0])
def test_decontamination_against_brute_force(spark, most):
    rng = random.Random(31)
    names, units = ["Alice", "Bob", "Carol", "Dave"], ["km", "kg", "minutes"]

    def question():
        words = sentence(rng, rng.randrange(6, 26)).split()
        for k in range(0, len(words), 4):
            words[k] = rng.choice([rng.choice(names), str(rng.randrange(100)), f"{rng.randrange(9)} {rng.choice(units)}", words[k], f"((({words[k]})))..."])
        return " ".join(words)

    items = [(i, question()) for i in range(25)] + [(90, "one two three"), (91, "What nine words stand in this very short question?")]
    rows = []
    for d in range(60):
        _, text = rng.choice(items)
        words = text.split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice([*names, "7", "55", "other"])
        rows.append((d, f"{sentence(rng, 3)}. {' '.join(words)} {sentence(rng, 4)}" if d % 3 else sentence(rng, 40)))
    rows += [(100, "so: what NINE words stand in this very short question ... yes"), (101, None), (102, items[3][1].upper())]
    want = {(d, i) for d, t in rows for i, q in items if plain_leaks(t or "", q)}
    assert (100, 91) in want and (102, 3) in want and len(want) > 25
    frames = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(*frames, most=most).collect()} == want
    assert {r.doc_id for r in decontaminate.drop_leaks(*frames, most=most).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_decontamination_runs_are_the_same_by_join(spark):
    rng = random.Random(4)
    a, b, c = (sentence(rng, 20) for _ in range(3))
    items = spark.createDataFrame([(10, f"{a} on Monday {b} on Monday {c}")], "item_id long, text string")
    rows = frame(spark, [(1, f"so {a} on Monday {b} on Tuesday {c}"), (3, f"{a} on Tuesday {b} on Tuesday {c}")])
    runs = [sorted(tuple(r) for r in decontaminate.find_leaks(rows, items, most=m).collect()) for m in (None, 0)]
    assert runs[0] == runs[1] and len(runs[0]) == 3


def test_shares():
    assert mixing.share_out(90, [1, 1, 1], [10, 100, 100]) == [10, 40, 40]
    budgets = mixing.leaf_budgets({("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 5}, {}, 60, 1)
    assert budgets == {("a", "x"): 10, ("a", "y"): 45, ("b", "z"): 5}


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["en", "de", None]), rng.choice(["s1", "s2"]), rng.randrange(0, 40)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, tokens long")
    weights = {("en",): 5.0}
    plan = mixing.plan_mix(df, "doc_id", ("lang", "source"), weights, 0.9, epochs=2)
    taken = mixing.take_mix(df, plan, "doc_id", ("lang", "source")).collect()
    budgets = mixing.leaf_budgets({(l, s): sum(r[3] for r in rows if r[1:3] == (l, s)) for _, l, s, _ in rows}, weights, 0.9 * sum(r[3] for r in rows), 2)
    keep = Counter((r.doc_id, r.epoch) for r in taken)
    for (lang, source), budget in budgets.items():
        mine = [r for r in rows if r[1:3] == (lang, source)]
        total = sum(r[3] for r in mine)
        full = min(budget // total, 2)
        places = {r.doc_id: r.p for r in spark.createDataFrame(mine, df.schema).select("doc_id", mixing._place(F.lit(full), "doc_id", mixing.SEED).alias("p")).collect()}
        want, left = Counter((r[0], e) for r in mine for e in range(full)), budget - full * total
        for r in sorted(mine, key=lambda r: places[r[0]]):
            left -= r[3]
            if left < 0 or full == 2:
                break
            want[r[0], full] += 1
        assert Counter({k: v for k, v in keep.items() if k[0] in {r[0] for r in mine}}) == want


def test_near_duplicates(spark):
    rng = random.Random(8)
    rows, base = [], [sentence(rng, 200).split() for _ in range(30)]
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(200)] = f"w{rng.random()}"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, rows[0][1]), (0, rows[0][1])]
    sets = [s for s in simhash.shingle_sets(pa.array([t or "" for _, t in rows]))]
    up = list(range(len(rows)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i in range(len(rows)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    want = {min(rows[k][0] for k in range(len(rows)) if root(k) == r) for r in {root(k) for k in range(len(rows))}}
    got = [r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(want)


def test_near_duplicates_at_the_border(spark):
    rng = random.Random(21)
    new = lambda n: [f"w{rng.random()}" for _ in range(n)]
    rows = []
    for i in range(400):  # 77 of 95 shingles in common, 0.81
        words = new(90)
        at = rng.randrange(4, 80)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:at] + new(5) + words[at + 5 :]))]
    template = new(90)
    for i in range(150):  # a template whose texts have 0.7 in common, each with a copy at 0.81
        words = new(8) + template[8:82] + new(8)
        at = rng.randrange(20, 70)
        rows += [(1000 + 2 * i, " ".join(words)), (1001 + 2 * i, " ".join(words[:at] + new(5) + words[at + 5 :]))]
    sets = list(simhash.shingle_sets(pa.array([t for _, t in rows])))
    for i in (0, 400, 799, 850, 1000):
        k = i - i % 2
        both = len(np.intersect1d(sets[k], sets[k + 1]))
        assert both >= 0.8 * (len(sets[k]) + len(sets[k + 1]) - both)
    same = len(np.intersect1d(sets[800], sets[802]))
    assert 0.6 * (2 * 86 - same) < same < 0.8 * (2 * 86 - same)
    got = [r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got) == [d for d, _ in rows if d % 2 == 0]


def test_many_leaves_are_shared_out_alike(spark):
    rng = random.Random(14)
    rows = [(i, rng.choice(["web0", "web1", None]), rng.choice(["en", "de", "fr"]), f"s{rng.randrange(30)}", rng.randrange(0, 60)) for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, tokens long")
    weights = {("web0",): 5.0, ("web1", "de"): 0.25, ("web0", "en", "s3"): 7.0, ("web1",): 0.5}
    for share in (0.3, 0.95):
        plans = [{r._leaf: tuple(r) for r in mixing.plan_mix(df, "doc_id", mixing.LEVELS, weights, share, epochs=2, max_leaves=m).collect()} for m in (50_000, 3)]
        assert plans[0] == plans[1] and len(plans[0]) > 200
    plan = mixing.plan_mix(df, "doc_id", mixing.LEVELS, weights, 0.5, epochs=2, max_leaves=3)
    one, two = (Counter(tuple(r) for r in mixing.take_mix(df.select("doc_id", *mixing.LEVELS), plan, "doc_id", mixing.LEVELS, max_leaves=m).collect()) for m in (50_000, 3))
    assert one == two and one


CLASHING = ("shard", "budget", "epoch", "_leaf", "_times", "_toxicity", "_id", "_node", "_row", "_key", "_maybe", "_md5", "_own", "packed", "domain", "tokens", "node", "score")


def stages():
    import corpus_pipeline

    return corpus_pipeline.STAGES


@pytest.mark.parametrize("name", ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"])
def test_stages_keep_columns_of_any_name(spark, sf_dir, texts, name):
    stage = dict(stages())[name]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").drop("shard")
    plain = stage(spark, docs, sf_dir)
    extra = list(CLASHING)
    more = docs.select("*", *[F.concat_ws("-", F.lit(c), F.col("doc_id")).alias(c) for c in extra])
    got = stage(spark, more, sf_dir)
    renamed = {"shard": "shard_input"} if name == "sharding" else {}
    assert got.columns == [*docs.columns, *(renamed.get(c, c) for c in extra), *(["shard"] if name == "sharding" else [])]
    rows = got.collect()
    for r in rows:
        for c in extra:
            assert r[renamed.get(c, c)] == (c if r.doc_id is None else f"{c}-{r.doc_id}")
    key = lambda r: (r["doc_id"], r["text"], r["lang"], r["source"])
    assert Counter(map(key, rows)) == Counter(map(key, plain.collect())) and rows


@pytest.mark.parametrize("name", ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"])
def test_stages_take_odd_rows(spark, sf_dir, empty_dir, name):
    stage = dict(stages())[name]
    rng = random.Random(9)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = sentence(rng, 60_000)
    rows = [(1, None, None, None, None), (2, "", "en", "src0", 0), (3, long, "en", "src0", 9), (3, long, "en", "src0", 9), (None, "lone text of some words", None, "src1", 1), (4, " \n", "de", "src1", 2)]
    got = stage(spark, spark.createDataFrame(rows, schema), sf_dir)
    ids = Counter(r.doc_id for r in got.collect())
    want = {"toxicity": {1: 1, 2: 1, 3: 2, 4: 1, None: 1}, "decontamination": {1: 1, 2: 1, 3: 2, 4: 1, None: 1}, "sharding": {1: 1, 2: 1, 3: 2, 4: 1, None: 1}, "near_dedup": {1: 1, 3: 1, None: 1}}
    assert ids == want.get(name, ids) and (name != "mixing" or set(ids) <= {1, 2, 3, 4, None})
    nothing = stage(spark, spark.createDataFrame([], schema), empty_dir)
    assert nothing.count() == 0 and nothing.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_against_brute_force(spark, sf_dir, texts):
    """What each stage keeps, worked out by plain loops from the stage before; the scores and the mix's cuts come from the operators."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [tuple(r) for r in docs.collect()]
    machine = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    least = float(machine.scores(pa.array([""]))[0])
    kept = [r for r in kept if (x := float(machine.scores(pa.array([r[1] or ""]))[0])) < 0.5 or x <= least]
    sets = simhash.shingle_sets(pa.array([r[1] or "" for r in kept]))
    up = list(range(len(kept)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i in range(len(kept)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    rank = lambda i: (kept[i][0] is None, kept[i][0] or 0, hashlib.md5((kept[i][1] or "").encode()).hexdigest())
    best = defaultdict(list)
    for i in range(len(kept)):
        best[root(i)].append(i)
    kept = [kept[min(g, key=rank)] for g in best.values()]
    item = [w.lower() for w in texts[8][1].split()]
    grams = {tuple(item[k : k + 13]) for k in range(len(item) - 12)}
    kept = [r for r in kept if not any(tuple(w[k : k + 13]) in grams for w in [[x.lower() for x in (r[1] or "").split()]] for k in range(len(w) - 12))]
    schema = docs.schema
    mixed = corpus_pipeline.mixing_stage(spark, spark.createDataFrame(kept, schema), sf_dir).collect()
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "text", "lang", "source", "shard_input", "shard"]
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in mixed) and 0 < len(got) < len(kept)
    score = lambda key, s: -1 / math.log((int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
    for r in got:
        key = "\x00null" if r.doc_id is None else str(r.doc_id)
        assert r.shard == max(range(24), key=lambda s: (score(key, s), -s))
