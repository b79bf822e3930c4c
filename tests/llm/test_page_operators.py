"""URL filters, WARC archives and vectors."""

import collections
import hashlib
import re

import numpy as np
import pytest

from tidelog.llm import registry, vector_dedup, warc

URLS = [
    None, "", "no scheme", "http://Example.COM/en/1", "http://www.example.com/en/2?x#y", "https://a.b.net/es/3", "https://net/fr/4", "http://x.com", "http://com/", "http://notcom/", "http://www.example.com/de/5#f",
    "http://u:p@h.org:80/12/a", "http://h.org?q", "http://h.org#f", "a://b://c/d", "http://é.org/x\ny", "http://h.org/12", "http://h.org/%20b c",
]


@pytest.fixture(scope="module")
def page_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pages"))
    big, other = "<p>" + "é" * 700, "z" * 999
    rows = [(i, u, h, "clash") for i, (u, h) in enumerate(zip(URLS * 2, [big, other, None, "", "x", "y" * 2000, big] * 5, strict=False))]
    rows += [(None, "http://h.org/n", big, None), (5, "http://h.org/12", "y" * 2000, None), (999, "http://h.org/last", big, "k")]
    spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(4).write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(12, 1, 0), (1, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_url_filters(spark, page_dir):
    d, rows = page_dir
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
    want = collections.Counter()
    for i, u, *_ in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest).group()
            path = re.match(r"[^?#]*", rest[len(host) :]).group()
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(r), r, a) for a, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        want[i, host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None] += 1
    got = collections.Counter()
    for r in registry.QUERIES["op4_url_filters"](spark, d).collect():
        assert r.verdict in ("allow", "block")
        got[r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None] += 1
    assert got == want


def test_reputation_shrinks(spark):
    from tidelog.llm.url_filters import host_reputation

    h = spark.createDataFrame([("bad.x.org", 200, 4), ("few.x.org", 1, 0), ("good.y.org", 200, 198), ("new.y.org", 0, 0), ("", 0, 0)], "host string, n long, k long")
    got = {r.host: r for r in host_reputation(h).collect()}
    assert not got["bad.x.org"].allowed and got["good.y.org"].allowed
    assert got["few.x.org"].mean > 0.01 and got["new.y.org"].mean > got["few.x.org"].mean
    assert all(0 <= r.below <= 1 and r.allowed == (r.below <= 0.05) for r in got.values())


def test_beta_tail_is_the_binomial_sum(spark):
    from fractions import Fraction
    from math import comb

    from pyspark.sql import functions as F

    from tidelog.llm.url_filters import beta_below

    df = spark.createDataFrame([(float(a), float(b)) for a in (1, 2, 7, 60, 900) for b in (1, 3, 40, 500)], "a double, b double")
    for x in (0.5, 0.2):
        for r in df.select("a", "b", beta_below(F.col("a"), F.col("b"), x).alias("p")).collect():
            n = int(r.a + r.b) - 1
            p = Fraction(int(x * 10), 10)
            want = float(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(int(r.a), n + 1)))
            assert abs(r.p - want) < 1e-9


def test_domains(spark):
    from pyspark.sql import functions as F

    from tidelog.llm.url_filters import bare_host, registered_domain, suffix_of

    want = {
        "h.org:80": ("h.org", "h.org", "org"), "u:p@h.org:80": ("h.org", "h.org", "org"), "10.1.2.3": ("10.1.2.3",) * 3, "x.me.uk": ("x.me.uk", "x.me.uk", "me.uk"),
        "a.b.co.uk": ("a.b.co.uk", "b.co.uk", "co.uk"), "[::1]:8080": ("[::1]",) * 3, "localhost": ("localhost",) * 3, "": ("",) * 3, "w.x.com.": ("w.x.com", "x.com", "com"),
    }
    b = bare_host(F.col("h"))
    for r in spark.createDataFrame([(x,) for x in want], "h string").select("h", b.alias("b"), registered_domain(b).alias("d"), suffix_of(registered_domain(b)).alias("s")).collect():
        assert (r.b, r.d, r.s) == want[r.h]


def test_warc_query(spark, page_dir):
    d, rows = page_dir
    groups = collections.defaultdict(list)
    for i, _, h, _ in rows:
        groups[(h or "").encode()].append(i)
    want = collections.Counter()
    for i, _, h, _ in rows:
        p = (h or "").encode()
        last = max((x for x in groups[p] if x is not None), default=None)
        refers = last if len(p) >= 1000 and last is not None and i != last else None
        want[i, len(p), hashlib.sha1(p).hexdigest(), "response" if refers is None else "revisit", refers] += 1
    got = registry.QUERIES["op8_warc"](spark, d).collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_warc_lookup(spark, page_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    d, rows = page_dir
    folder = str(tmp_path / "arc")
    entries = warc.write_archive(warc.revisits(spark.read.parquet(f"{d}/pages.parquet")), f"{folder}/records")
    index = warc.CaptureIndex(warc.build_index(entries, f"{folder}/index", lines=4), f"{folder}/index", f"{folder}/records")
    for url in set(URLS) - {None, ""}:
        found = index.lookup(url)
        assert {r["page_id"] for r in found} == {i for i, u, *_ in rows if u is not None and warc.url_key(u) == warc.url_key(url)}
        assert url.replace("\n", "%0A").replace(" ", "%20") in {r["url"] for r in found}
        for r in found:
            html = next(h for i, _, h, _ in rows if i == r["page_id"])
            assert r["record_type"] == "revisit" or r["payload"].decode() == (html or "")
    assert index.lookup("http://nowhere.example/") == []


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 40)  # so that buckets are cut into blocks
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    x = [b + rng.standard_normal(16) * 0.08 for b in base for _ in range(4)] + [base[0] + rng.standard_normal(16) * 0.02 for _ in range(150)]
    x = np.array(x, np.float32)
    x[5] = x[0] * 2
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(1000 + i, x[7].tolist(), "c") for i in range(5)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 3), (2004, [float("inf")] + [0.0] * 15), (2005, []), (2006, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows + [(i, v, "c") for i, v in odd] + [(None, x[3].tolist(), None)], "vec_id long, embedding array<float>, rep string").repartition(3)
    ids = [r[0] for r in rows]
    u = np.array([r[1] for r in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    got = {r.id: r for r in vector_dedup.near_vectors(df).collect()}
    assert len(got) == len(rows) + len(odd) + 1
    n = np.array([got[i].n_links for i in ids])
    assert (n <= link.sum(axis=1)).all() and n.sum() >= 0.98 * link.sum()
    for i, _ in odd:
        assert (got[i].n_links, got[i].component_id) == (0, i)
    assert got[None].component_id is None
    assert got[1004].component_id == got[7].component_id and got[5].component_id == got[0].component_id


def test_vec_ids_are_the_nodes(spark):
    rng = np.random.default_rng(8)
    a, b, c, d = np.eye(16)[:4] + rng.standard_normal((4, 16)) * 0.01
    near = a + rng.standard_normal(16) * 0.005
    for kind in ("float", "double"):
        # 1 twice with one vector; 2 with vectors near a and near b; 3 near a; 4, 5 equal to b; 6 beside; 7 with c and d; 8 equal to c
        rows = [(1, a), (1, a), (2, near), (2, b), (3, a * 2), (4, b), (5, b), (6, -a), (7, c), (7, d), (8, c)]
        df = spark.createDataFrame([(i, [float(np.float32(x)) for x in v]) for i, v in rows], f"vec_id long, embedding array<{kind}>").repartition(3)
        got = {(r.id, r.n_links, r.component_id) for r in vector_dedup.near_vectors(df).collect()}
        assert got == {(1, 2, 1), (2, 4, 1), (3, 2, 1), (4, 2, 1), (5, 2, 1), (6, 0, 6), (7, 1, 7), (8, 1, 7)}


@pytest.mark.parametrize("size", [16, 64, 256, 1024])
def test_recall_of_pairs_at_the_threshold_holds_at_every_code_size(size):
    code = vector_dedup.CapCode(64, size)
    x, y = vector_dedup._pairs(64, 0.95, np.random.default_rng(size), 1000)
    x[:200, :32] *= 0.2  # most of the length in one block
    x[:200] /= np.linalg.norm(x[:200], axis=1, keepdims=True)
    d = np.random.default_rng(7).standard_normal((200, 64))
    d -= (d * x[:200]).sum(axis=1, keepdims=True) * x[:200]
    y[:200] = 0.95 * x[:200] + np.sqrt(1 - 0.95**2) * d / np.linalg.norm(d, axis=1, keepdims=True)
    keys = [r.astype(np.int64) * (1 << 40) + f for r, f in (code.decode(x), code.decode(y))]
    met = np.zeros(1000, bool)
    met[np.intersect1d(*keys) >> 40] = True
    assert met[:200].mean() >= 0.9 and met[200:].mean() >= 0.9
