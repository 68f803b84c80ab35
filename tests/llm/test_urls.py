import brute
import pytest

from __spark_entry__ import queries
from cohortis.llm import url_filter
from cohortis.llm.queries import RULES
from conftest import SF

URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.ORG/es/a?x=/de/", "https://a.example.org/en/1x#f", "ftp://com/fr/",
    "x://b.com/de/", "x://b.com/fr/?q", "x://org", "x://org?/", "x://notexample.org/es/", "x://example.org:80/es/",
    "a://b://c.com/de/", "http://É.COM/fr/ü", "http://h.co.uk/p", "http://x.y.co.uk", "http://h\n.com/de/", "://host/p",
]


def test_parts_and_rules_equal_brute_force(spark):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id long, url string, bad int")
    for r in url_filter.filter_urls(df, RULES).collect():
        host, path = brute.url_parts(URLS[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path), URLS[r["page_id"]]
        rule = brute.matching_rule(host, path, RULES)
        assert (r["rule"], r["verdict"]) == (rule or (None, "allow"))


def test_domains(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("x.example.org",), ("org",), ("",), ("x.example.org:8080",), ("10.0.0.1:80",)], "h string")
    got = df.select(url_filter.domain_of(df.h), url_filter.suffix_of(df.h)).collect()
    assert [tuple(r) for r in got] == [("b.co.uk", "co.uk"), ("example.org", "org"), ("org", "org"), ("", ""), ("example.org", "org"),
                                        ("10.0.0.1", "10.0.0.1")]


def reputation(rows, z=1.645):
    """Plain version of the shrinkage on [(host, bad or None)]."""
    def level(groups, prior):
        over = sum((b - n * prior[g]) ** 2 - n * prior[g] * (1 - prior[g]) for g, (n, b) in groups.items())
        room = sum(n * (n - 1) * prior[g] * (1 - prior[g]) for g, (n, b) in groups.items())
        rho = min(max(over / room, url_filter.MIN_RHO), url_filter.MAX_RHO) if room > 0 else url_filter.MAX_RHO
        k = 1 / rho - 1
        return {g: ((b + k * prior[g]) / (n + k), n + k) for g, (n, b) in groups.items()}

    def add(key):
        out = {}
        for h, b in rows:
            n, s = out.get(key(h), (0, 0))
            out[key(h)] = (n + (b is not None), s + (b or 0))
        return out

    domain, suffix = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    tops, domains, hosts = add(suffix), add(domain), add(lambda h: h)
    all_n, all_b = sum(n for n, _ in tops.values()), sum(b for _, b in tops.values())
    top = level(tops, dict.fromkeys(tops, (all_b + 0.5) / (all_n + 1)))
    mid = level(domains, {d: top[suffix(d)][0] for d in domains})
    low = level(hosts, {h: mid[domain(h)][0] for h in hosts})
    return {h: (m, m - z * (m * (1 - m) / (s + 1)) ** 0.5) for h, (m, s) in low.items()}


def test_reputation_equals_plain_version(spark):
    rows = []
    for d in range(6):
        for h in range(4):
            for i in range(3 + 20 * (h == 0)):
                bad = None if (i + h) % 5 == 0 else int(d == 0 or (i * 7 + d) % 6 == 0)
                rows.append((f"h{h}.dom{d}.{'net' if d % 2 else 'com'}", bad))
    rows.append(("only.unlabelled.com", None))
    df = spark.createDataFrame(rows, "host string, bad int")
    got = {r["host"]: (r["mean"], r["lower"]) for r in url_filter.host_reputation(df).collect()}
    want = reputation(rows)
    assert set(got) == set(want)
    for h in want:
        assert got[h] == pytest.approx(want[h])
    pages = spark.createDataFrame([(f"http://{h}/p", b, 1) for h, b in rows], "url string, bad int, host int")
    verdicts = {r["host"]: r["verdict"] for r in url_filter.filter_urls(pages, []).collect()}
    assert verdicts["h0.dom0.com"] == "block" and verdicts["h0.dom1.net"] == "allow"


def test_no_labels_and_no_pages(spark):
    df = spark.createDataFrame([("http://a.com/x", None)] * 3, "url string, bad int")
    assert {r["verdict"] for r in url_filter.filter_urls(df, []).collect()} == {"allow"}
    assert url_filter.filter_urls(df.limit(0), RULES).count() == 0


def test_url_query(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries()["op8_url_filter"](spark, SF).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = brute.url_parts(urls[r["page_id"]])
        rule = brute.matching_rule(host, path, RULES)
        assert (r["host"], r["path"]) == (host, path) and r["rule"] == (rule and rule[0])
        assert r["verdict"] == (rule[1] if rule else r["verdict"])


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([("http://a.com/x", 0, 5, 6, 7, 8)], "url string, bad int, bad_lower int, __host int, bad_rate int, rule int")
    got = url_filter.filter_urls(df, RULES)
    assert got.columns == ["url", "bad", "host", "path", "bad_rate", "bad_lower", "rule", "verdict"]
    assert got.first()["verdict"] == "allow" and got.first()["bad_lower"] < got.first()["bad_rate"] < 1


def test_query_blocks_hosts_by_reputation(spark, tmp_path):
    import oracle
    from cohortis.llm import sql

    pages = [(i, f"http://h{i % 3}.{'bad' if i % 6 < 3 else 'good'}.net:8080/p/{i}") for i in range(300)]
    pages += [(900, "http://10.0.0.1/p/1"), (901, None), (902, "http://x.co.uk/p/2")]
    labels = [(i, int(i % 6 >= 3 or i % 10 == 0), 0) for i in range(250)]
    con = oracle.duckdb.connect()
    for name, rows, schema in (("pages", pages, "page_id long, url string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries()["op8_url_filter"](spark, str(tmp_path))
    assert oracle.compare("op8", got, con, sql.url_filter(RULES)) == []
    verdicts = {(r["host"], r["verdict"]) for r in got.where("host like '%net:8080'").collect()}
    assert verdicts == {(f"h{h}.{d}.net:8080", "block" if d == "bad" else "allow") for h in range(3) for d in ("bad", "good")}
