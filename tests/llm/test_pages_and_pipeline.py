import corpus_pipeline
import pytest
from check_oracles import connect
from pyspark.sql import functions as F

from rankforge.llm import queries, url_filter, warc_fixity
from tests_llm import ODD, docs, words  # noqa: F401


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    want = connect(sf_dir).execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert ordered(df.select(*names).collect()) == ordered(want)


def test_urls(spark, monkeypatch):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "a://b.example.com/en", "a://b.example.com/en/",
            "a://NET/es/", "a://xnet/es/", "a://user@h.net:8/es/", "a://com", "a://com/", "a://.com/", "x\n://é.com/ü#"]
    rules = [url_filter.parse_rule(r) for r in queries.URL_RULES]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")

    def brute(host, path):
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (r.host.count("."), len(r.path)), default=None)
        return (best.name, best.verdict) if best else (None, "allow")

    for size in (url_filter.RULES_PER_TRIE, 2):
        monkeypatch.setattr(url_filter, "RULES_PER_TRIE", size)
        got = url_filter.filter_urls(pages, rules).collect()
        assert len(got) == len(urls)
        for r in got:
            assert tuple(r.url_match)[2:] == brute(r.url_match.host, r.url_match.path)
    assert got[4].url_match.host == "www.example.com" and got[4].url_match.path == "/en/x"
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []


def test_audit(spark):
    sound = [("a", i, f"record {i}") for i in range(300)] + [("b", 1, "x"), ("b", 2, None), (None, None, "y"), ("c", 5, "z"), ("c", 5, "z")]
    bad = [r for r in sound if r[:2] not in (("a", 7), ("b", 1))]
    bad = [(a, i, "changed" if (a, i) == ("a", 299) else t) for a, i, t in bad] + [("a", 1000, "new"), ("d", 1, "new")]
    bad.remove(("c", 5, "z"))

    def records(rows):
        df = spark.createDataFrame(rows, "archive string, record_id long, text string")
        return df.selectExpr("archive", "record_id", "cast(text AS binary) AS record", "1 AS node", "2 AS hash")

    got = {(r.archive, r.record_id): r.fault for r in warc_fixity.audit(records(sound), records(bad)).collect()}
    assert got == {("a", 7): "missing", ("b", 1): "missing", ("a", 299): "altered", ("c", 5): "altered", ("a", 1000): "extra", ("d", 1): "extra"}
    assert warc_fixity.audit(records(sound), records(sound[::-1])).collect() == []
    none = records(sound).limit(0)
    assert warc_fixity.audit(none, none).collect() == []
    assert {r.fault for r in warc_fixity.audit(none, records(sound)).collect()} == {"extra"}
    assert {r.fault for r in warc_fixity.audit(records(sound), none).collect()} == {"missing"}


def test_stages(spark, sf_dir, docs):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs(ODD), sf_dir)
        assert kept.columns == docs(ODD).columns, name
        kept.collect()
        assert stage(spark, docs([]), sf_dir).collect() == [], name
        assert stage(spark, table, sf_dir).count() > 0.5 * table.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs([]), sf_dir).collect() == []


def test_pipeline(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(got) == len({r.doc_id for r in got}) > 100
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)
