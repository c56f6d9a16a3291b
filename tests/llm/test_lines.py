import re

from pyspark.sql import functions as F

from edgeloom.llm import lines

SCHEMA = "page_id long, url string, html string, host string, lines string, _kept string"


def page(i, *extra):
    return f"<html><head><title>t</title><script>var a = '<p>no</p>';</script></head><body><nav>Home</nav><p>Own line {i} <b>bold</b></p>{''.join(f'<div> {x} </div>' for x in extra)}<!-- gone --></body></html>"


def test_boilerplate_goes(spark):
    rows = [(i, f"https://user@Big.example:80/{i}", page(i, "Common footer", *(["Sometimes"] if i % 15 == 0 else []))) for i in range(60)]
    rows += [(100 + i, f"http://small.example/{i}", page(100 + i, "Common footer")) for i in range(10)]
    rows += [(300 + i, f"http://tiny.example/{i}", page(300 + i, "Common footer")) for i in range(2)]
    rows += [(200, None, None), (201, "relative/path", ""), (202, "http://big.example/x", None), (3, "http://big.example/3", page(3, "Common footer"))]
    df = spark.createDataFrame([(*r, "own host", "own lines", "own kept") for r in rows], SCHEMA)
    got = lines.drop_lines(df)
    assert got.columns == ["page_id", "url", "lines", "_kept", "host", "n_lines", "n_dropped", "clean_text"]
    found = {r.page_id: r for r in got.collect()}
    assert got.count() == len(rows) and {r._kept for r in found.values()} == {"own kept"}
    assert found[1].clean_text == "Own line 1 bold" and found[1].n_lines == 3 and found[1].n_dropped == 2 and found[1].host == "big.example"
    assert found[15].clean_text == "Own line 15 bold\nSometimes"
    assert found[105].n_dropped == 2 and found[105].clean_text == "Own line 105 bold", "small hosts are judged alike"
    assert found[301].n_dropped == 0 and found[301].clean_text == "Home\nOwn line 301 bold\nCommon footer", "two pages make no boilerplate"
    assert found[200].host == "" and found[200].n_lines == 0 and found[202].clean_text == ""


def test_against_counts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    ratio, least = 0.05, 2
    rows = pages.select("page_id", lines.host_of(F.col("url")).alias("host"), lines.lines_of(F.col("html")).alias("ls")).collect()
    total, seen = {}, {}
    for r in rows:
        total[r.host] = total.get(r.host, 0) + 1
        for x in set(r.ls):
            seen[r.host, x] = seen.get((r.host, x), 0) + 1
    want = {r.page_id: [x for x in r.ls if not (seen[r.host, x] >= least and seen[r.host, x] > ratio * total[r.host])] for r in rows}
    got = lines.drop_lines(pages, ratio, least).collect()
    assert {r.page_id: r.clean_text for r in got} == {i: "\n".join(x) for i, x in want.items()} and any(r.n_dropped for r in got)


def test_native_and_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lines.drop_lines(df).count() == 0
    plan = lines.report(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
