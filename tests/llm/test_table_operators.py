"""PII, sharding, the URL graph, embeddings, the Jaccard join and the pipeline against brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import components, hostgraph, jaccard, neardup, pii, sharding
from tests.llm.conftest import SCHEMA, best_windows, passage, thue_morse


def _luhn(v):
    total = 0
    for i, c in enumerate(reversed(v)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _base_pii(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        v = re.sub("[^0-9]", "", m[0])
        if 14 <= len(v) <= 19 and _luhn(v):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_pii_base_spans(spark):
    rng = random.Random(5)
    parts = ["a@b.c", "@", "_d", ".", "1", "22", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "5", " ", "-", "+1 (212) 555-0100", "+", "(", ")", "é", "😀", "1.2.3.4", "0000001", "4111111111111111", "\n", "tel ", "bob [at] mail.org", "212-555-0199"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digests(df).collect():
        base = _base_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), texts[r["doc_id"]]
        assert r["n_email"] == base.count("email") and r["n_card"] == base.count("card")
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_pii_odd_rows_and_mask(spark, clashing, no_docs):
    assert pii.digests(clashing).count() == clashing.count()
    assert pii.digests(no_docs).count() == 0
    df = spark.createDataFrame([(1, "mail a@b.org now 1.2.3.4", None, None, None), (2, None, None, None, None)], SCHEMA)
    out = pii.find(df, "text", "_spans").withColumn("m", pii.masked(F.col("text"), F.col("_spans")))
    assert {r["doc_id"]: r["m"] for r in out.collect()} == {1: "mail <EMAIL> now <IP>", 2: None}


def test_pii_long_runs_are_linear(spark):
    df = spark.createDataFrame([(1, "a" * 300_000 + "@"), (2, "1" * 300_000), (3, "1.2" * 2_000), (4, "+1" + " " * 200_000), (5, "1 " * 100_000)], "doc_id long, text string")
    assert pii.digests(df).where("base_sha256 <> sha2('', 256)").count() == sum(_base_pii(r["text"]) != "" for r in df.collect())


def test_pii_of_a_text_with_many_matches(spark):
    """Several blocks of matches, with wide characters between; time grows with the text, not with its square."""
    text = "".join(f"é😀 u{i}@mail.org, 10.0.{i % 256}.{i % 99} +1 (212) 555-{i % 10000:04d}; " for i in range(700))
    (r,) = pii.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r["base_sha256"] == hashlib.sha256(_base_pii(text).encode()).hexdigest() and r["n_email"] == 700
    took = []
    for n in (8_000, 32_000):
        df = spark.createDataFrame([(1, " ".join(f"u{i}@mail.org" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        assert pii.digests(df).first()["n_email"] == n
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 6, took


def test_masked_spans_that_overlap(spark):
    spans = [(0, 0, 2), (1, 1, 5), (5, 2, 6), (7, 3, 300), (8, 0, 9), (290, 1, 310), (305, 2, 320), (320, 3, 321)] + [(400 + 2 * i, i % 4, 401 + 2 * i) for i in range(300)]
    text = "".join("é😀xyz"[i % 5] for i in range(1200))
    out, at = "", 0
    for a, k, b in spans:
        if a >= at:
            out += text[at:a] + f"<{pii.KINDS[k][0].upper()}>"
        at = max(at, b)
    df = spark.createDataFrame([(text, [(a, k, b) for a, k, b in spans])], "text string, s array<struct<start:int,k:int,end:int>>")
    assert df.select(pii.masked(F.col("text"), F.col("s"))).first()[0] == out + text[at:]


def test_reliabilities_rank_labelers(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(4000):
        y = 1 if rng.random() < 0.6 else -1
        rows.append(([y if rng.random() < a else -y for a in (0.95, 0.8, 0.6, 0.9)],))
    patterns = spark.createDataFrame(rows, "votes array<int>").groupBy("votes").agg(F.count("*").alias("n"))
    m = patterns.agg(pii.estimate_reliabilities(patterns).alias("m")).first()["m"]
    good = [m["yes"][k][2] for k in range(4)]
    assert good[0] > good[3] > good[1] > good[2] and abs(m["prior"] - 0.6) < 0.05


def test_shards(spark, clashing, no_docs):
    rows = sharding.shard(clashing, 4, seed=2).collect()
    assert len(rows) == clashing.count()
    counts = [sum(r["shard"] == k for r in rows) for k in range(4)]
    assert max(counts) - min(counts) <= 1
    for k in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(counts[k]))
    texts = {r["doc_id"]: r["text"] or "" for r in clashing.collect()}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
    again = sharding.shard(clashing.repartition(7), 4, seed=2).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    assert sharding.shard(no_docs, 4).count() == 0


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 3, 7, 10, 99, 1000, 4097):
        got = sorted(r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5)).collect())
        assert got == list(range(n)), n


def _rank(edges, seeds, d=0.85, steps=200):
    hosts = sorted({h for e in edges for h in e[:2]} | set(seeds))
    total = sum(seeds.values())
    p = {h: seeds.get(h, 0) / total for h in hosts}
    r = dict(p)
    out = {}
    for s, t, n in edges:
        out.setdefault(s, []).append((t, n))
    for _ in range(steps):
        new = dict.fromkeys(hosts, 0.0)
        for s, own in out.items():
            for t, n in own:
                new[t] += d * r[s] * n / sum(x for _, x in own)
        left = 1 - sum(new.values())
        r = {h: new[h] + left * p[h] for h in hosts}
    return r


def test_personalised_rank(spark):
    edges = [("a", "b", 1), ("a", "c", 3), ("b", "c", 1), ("c", "a", 1), ("d", "a", 2), ("c", "e", 1)]
    seeds = {"a": 2.0, "d": 1.0}
    got = hostgraph.personalised_rank(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "host string, weight double"))
    want = _rank(edges, seeds)
    rows = got.collect()
    assert {r["host"] for r in rows} == {h for h, x in want.items() if x > 0}
    assert all(abs(r["rank"] - want[r["host"]]) < 1e-5 for r in rows)


def test_url_rules(spark):
    rows = [
        (1, "https://Www.Example.ORG/es/1?q#x", None),
        (2, "https://example.org/en/12", "<a href='http://bad.test/'>"),
        (3, "http://org", None),
        (4, "http://shop.com/fr/2", '<a href="//bad.test/x">'),
        (5, None, None),
        (6, "no scheme", ""),
        (7, "http://bad.test/a", '<a href="http://x.com/de/">'),
        (8, "http://x.com/de/1", None),
        (9, "http://other.test?a/b", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in hostgraph.judge(df).collect()}
    assert got[1] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("org", "", None, "allow")
    assert got[4] == ("shop.com", "/fr/2", "com/fr/", "allow")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[8] == ("x.com", "/de/1", "com/de/", "block")
    assert got[9] == ("other.test", "", None, "allow")
    assert hostgraph.judge(df.limit(0)).count() == 0


def test_host_verdicts(spark):
    """Scores and verdicts of all pages against brute force, with repeated rows, clashing columns and links of all forms."""
    rng = random.Random(12)
    hosts = [f"h{k}.test" for k in range(25)] + ["shop.com", "x.com", "www.example.org", "a.org"]
    rows, links, good, bad = [], {}, {}, {}
    for i in range(160):
        host = rng.choice(hosts + hosts[25:] * 5)
        path = rng.choice(["/de/1", "/fr/2", "/es/3", "/en/12", "/", ""])
        to = [rng.choice(hosts) for _ in range(rng.randint(0, 3))]
        html = " ".join(rng.choice(["<a href='http://{}/q'>", '<a class="x" href="//{}?a">', '<A HREF = "https://{}#b">']).format(t.upper() if rng.random() < 0.3 else t) for t in to)
        for _ in range(rng.choice([1, 1, 1, 2])):
            rows.append((i, f"http://{host}{path}", html or None))
    for i, url, html in rows:
        host, path = re.match("http://([^/]*)(.*)", url).groups()
        fits = [r for r in hostgraph.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        if fits:
            side = good if max(fits, key=lambda r: len(r.name)).verdict == "allow" else bad
            side[host] = side.get(host, 0) + 1
        for target in {re.sub("^https?:", "", x) for x in set(re.findall("//[^\"'>]+", html or ""))}:
            dst = re.match("//([^/?#]*)", target)[1].lower()
            if dst != host:
                links[host, dst] = links.get((host, dst), 0) + 1
    assert len(good) > 2 and len(bad) > 2
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, host string, verdict string")
    edges = {(r["src"], r["dst"]): r["n"] for r in hostgraph.host_edges(df.select("html", F.regexp_extract("url", "//([^/]*)", 1).alias("host"))).collect()}
    assert edges.keys() == links.keys()
    trust = _rank([(a, b, n) for (a, b), n in edges.items()], good)
    distrust = _rank([(b, a, n) for (a, b), n in edges.items()], bad)
    got = hostgraph.judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["trust"] - trust.get(r["host"], 0)) < 1e-5 and abs(r["distrust"] - distrust.get(r["host"], 0)) < 1e-5
        if r["rule"] is None and abs(r["trust"] - r["distrust"]) > 1e-5:
            assert r["verdict"] == ("block" if r["distrust"] > r["trust"] else "allow")
    assert {"block", "allow"} <= {r["verdict"] for r in got if r["rule"] is None}


@pytest.mark.parametrize("one_task", [0, components.ONE_TASK])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def _brute_jaccard(rows, k=3, threshold=90):
    sets = []
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets.append(frozenset(zip(*(w[j:] for j in range(k)))) or (frozenset([tuple(w)]) if w else frozenset()))
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)), key=repr)


def test_jaccard_odd_rows(spark, clashing, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in clashing.collect()]
    assert sorted(map(tuple, jaccard.linked(clashing).collect()), key=repr) == _brute_jaccard(rows)
    assert jaccard.linked(no_docs).count() == 0


def test_jaccard_groups(spark):
    rng = random.Random(6)
    rows, i = [], 0
    for k in range(12):
        base = passage(k, rng.randint(4, 150)).split()
        for _ in range(rng.choice([1, 3, 30])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 9)}"
            rows.append((i, " ".join(w)))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.linked(docs).collect()), key=repr) == _brute_jaccard(rows)


def test_jaccard_of_thue_morse_words(spark):
    """Two words that collide under polynomials: 17 of 19 shingles are common, less than nine tenths."""
    common = " ".join(f"c{j}" for j in range(19))
    rows = [(i, f"{common} {thue_morse(n, *ab)}") for i, (n, ab) in enumerate((n, ab) for n in (10, 12) for ab in ("ab", "ba"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.linked(docs).collect()), key=repr) == _brute_jaccard(rows)


def test_jaccard_in_blocks(spark, monkeypatch):
    """Columns of more than a few entries are wide, partners fill many blocks and pairs are not broadcast."""
    rng = random.Random(16)
    rows, i = [], 0
    for k, copies in enumerate((40, 25, 6, 3, 2, 1, 1)):
        base = passage(k, 60).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 9)}"
            rows.append((i, " ".join(w)))
            i += 1
    monkeypatch.setattr(jaccard, "WIDE", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "FEW_PAIRS", 0)
    monkeypatch.setattr(jaccard, "PARTNERS", 5)
    monkeypatch.setattr(jaccard, "BROADCAST_PAIRS", 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.linked(docs).collect()), key=repr) == _brute_jaccard(rows)


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(60):
        rows.append((1000 + i, (base[i % 20] + rng.normal(size=32) * 0.05).tolist()))
    rows += [(2000, base[0].tolist()), (2000, base[0].tolist()), (2001, None), (2002, []), (2003, [0.0] * 32), (2004, [float("nan")] * 32), (2005, [1.0] * 5), (None, base[1].tolist()), (2006, [float("inf")] + [1.0] * 31)]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, label int")
    for c in ("id", "key", "vector", "members", "shard", "i", "j", "block", "near", "root", "component"):
        df = df.withColumn(c, F.lit("x"))
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    x = np.zeros((len(rows), 32))
    ok = []
    for k, r in enumerate(df.collect()):
        v = r["embedding"]
        good = r["vec_id"] is not None and v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)
        ok.append(good)
        if good:
            x[k, : len(v)] = v
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    links = ((x / np.where(norms > 0, norms, 1)) @ (x / np.where(norms > 0, norms, 1)).T >= 0.95) & np.outer(ok, ok)
    np.fill_diagonal(links, False)
    _same_links(got, [r[0] for r in rows], links)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def _same_links(got, ids, links):
    """n_links and component_id of every row as brute force gives them."""
    parent = list(range(len(ids)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in zip(*np.nonzero(links)):
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = sorted(((i, int(links[k].sum()), None if i is None else least[find(k)]) for k, i in enumerate(ids)), key=repr)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_near_duplicates_of_any_scale(spark):
    """Components whose squares overflow or vanish; equal, scaled and opposite vectors, a link of exactly the cosine's side."""
    base = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, [c * 1e200 for c in base]), (2, [c * 2e200 for c in base]), (3, [c * 1e-200 for c in base]), (4, base), (5, [-c for c in base]), (6, [4.0, 3.0, 2.0, 1.0]), (7, [1.0, 2.0, 3.0, 4.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (0, 5), 6: (0, 6), 7: (4, 1)}


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 24))
    x = np.r_[x, x[:100] + rng.normal(size=(100, 24)) * 0.04]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, v = neardup.range_search(x, neardup.pruned_graph(x), 0.95)
    true = x @ x.T >= 0.95
    np.fill_diagonal(true, False)
    assert true[q, v].mean() > 0.999 and len(q) >= 0.9 * true.sum()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        words = passage(i % 97, 30 + i % 50).split() + [f"u{i}x{j}" for j in range(40 if i % 10 else 4)]
        if i % 6 == 0:
            words[3:3] = ["scoundrelly", "nitwits"]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(i % 6 == 0)))
    item = passage(55, 40)
    rows.append((900, "start " + item + " end " + passage(60, 30), "en", "s", 0))
    rows.append((901, rows[1][1], "en", "s", 0))
    rows.append((902, "write to bob@mail.org please " + " ".join(f"z{j}" for j in range(30)), "en", "s", 0))
    rows.append((903, None, "en", "s", None))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
    kept = {r["doc_id"]: r for r in docs.collect()}
    toxic = {i for i in range(300) if i % 6 == 0}
    assert not toxic & kept.keys()
    assert {1, 902, 903} <= kept.keys() and 901 not in kept and 900 not in kept
    assert "<EMAIL>" in kept[902]["text"] and kept[902]["n_chars"] == len(kept[902]["text"])
    rest = [(r[0], r[1]) for r in rows if r[0] not in toxic]
    firsts = {c for _, _, c in _brute_jaccard(rest, 5, 80)}
    assert kept.keys() == {i for i, t in rest if i in firsts and not best_windows(t, [(1, item)])}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == kept.keys() and all(r["round_trip"] for r in out)


def test_pipeline_drops_near_copies(spark, tmp_path):
    """Two distant words of 100 changed: 86/106 of five-word shingles stay, 92/104 of three-word ones; four changed: 76/116."""
    from larkspur.llm import stages

    base = [f"w{j}" for j in range(100)]

    def changed(*at):
        return " ".join(f"other{j}" if j in at else w for j, w in enumerate(base))

    docs = spark.createDataFrame([(1, changed(), "en", "s", 0), (2, changed(30, 70), "en", "s", 0), (3, changed(20, 40, 60, 80), "en", "s", 0)], SCHEMA)
    assert {r["doc_id"] for r in stages.one_of_each_group(spark, docs, str(tmp_path)).collect()} == {1, 3}


def test_rank_reaches_the_end_of_long_chains(spark):
    """Rank halves only after four links, so both ends of a chain of 40 hosts need more steps than 20."""
    edges = [(f"h{i:02d}", f"h{i + 1:02d}", 1) for i in range(40)] + [("h40", "h00", 1)]
    got = hostgraph.personalised_rank(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([("h00", 1.0)], "host string, weight double"))
    ranks = {r["host"]: r["rank"] for r in got.collect()}
    want = _rank(edges, {"h00": 1.0})
    assert ranks.keys() == want.keys()
    assert sum(abs(ranks[h] - want[h]) for h in want) < 1e-5 and ranks["h40"] > 0


def _reps(spark, x):
    rows = [(i, 1, bytearray(np.asarray(v, np.float64).tobytes())) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, members long, vector binary")


def _books(first, second=None):
    books = neardup.Codebooks.__new__(neardup.Codebooks)
    books.first, books.second = first, second
    return books


def test_search_follows_lists_across_shards(spark):
    """On an arc: 0 and 2 are in range but share no shard; 1 shares one with each."""
    arc = lambda *degrees: np.stack([np.cos(np.radians(degrees)), np.sin(np.radians(degrees))], 1)
    rows, pairs = neardup.linked(_reps(spark, arc(0, 9, 17)), 2, _books(arc(-10, 2, 16, 28)), 2, 0.95)
    assert [tuple(r) for r in pairs.collect()] == [(0, 2)]
    assert {r["id"]: r["others"] for r in neardup._links(_reps(spark, arc(0, 9, 17)), rows, pairs).collect()} == {0: 2, 1: 2, 2: 2}


def _dense_group(n, group, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 24))
    x[:group] = x[0] + rng.normal(size=(group, 24)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = x @ x.T >= 0.95
    np.fill_diagonal(true, False)
    return x, true


def test_many_shards_with_a_dense_group(spark, monkeypatch):
    """A third of the vectors are distinct near copies, in more shards than any overlap reaches; a build that finds nothing is not accepted."""
    x, true = _dense_group(450, 150, 3)
    assert true.sum() > 15000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neardup, "SHARD_AIM", 8)
    rows = neardup.near_duplicates(df).collect()
    assert sum(r["n_links"] for r in rows) >= 0.95 * true.sum() and 0.95 <= rows[0]["audited_recall"] <= 1
    assert all(r["n_links"] <= n for r, n in zip(sorted(rows, key=lambda r: r["vec_id"]), true.sum(1)))
    empty = lambda reps, *_: (reps.select("id", F.lit(0).cast("long").alias("others"), F.col("id").alias("root")).limit(0), reps.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    monkeypatch.setattr(neardup, "linked", empty)
    monkeypatch.setattr(neardup, "EXACT_BLOCK", 200)
    _same_links(neardup.near_duplicates(df).collect(), list(range(450)), true)


def test_blocks_of_a_dense_shard_and_two_codebooks(spark, monkeypatch):
    """One shard cut into several blocks counts each pair once; so do shards of two codebooks."""
    x, true = _dense_group(600, 300, 5)
    reps = _reps(spark, x)
    monkeypatch.setattr(neardup, "SHARD_MOST", 128)
    for books in (_books(x[:1]), _books(x[300:304], x[304:307])):
        rows, pairs = neardup.linked(reps, 24, books, 2, 0.95)
        found = {r["id"]: r["others"] for r in neardup._links(reps, rows, pairs).collect()}
        assert all(n <= true[i].sum() for i, n in found.items())
        assert sum(found.values()) >= 0.95 * true.sum()
