import pytest
from pyspark.sql import functions as F

from orgweave.sources import captured, state, tabular


def test_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('﻿agency_domain,x,client_name\na.test,1,"P, Q"\na.test,2,P\n,,\nA.test,,"P, Q"\n', encoding="utf-8")
    rows = tabular.read_csv(spark, str(f), ["agency_domain", "client_name", "missing"])
    assert rows.count() == 3 and rows.columns == ["agency_domain", "client_name", "missing"]
    keyed = tabular.read_keyed(spark, str(f), ["agency_domain", "client_name", "x"], ["agency_domain", "client_name"])
    assert {(r.client_name, r.x) for r in keyed.collect()} == {("P, Q", None), ("P", "2")}
    tabular.write_csv(keyed, str(tmp_path / "out"), ["x", "client_name", "none"])
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["x", "client_name", "none"] and back.count() == 2
    with pytest.raises(ValueError, match="header"):
        tabular.check_header(["a", "b"], ["b"])
    assert tabular.check_header(["a", "b"], ["a"]) == ["b"]


def test_domain_lists(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# note\na.test\n\n b.test \n")
    (tmp_path / "l.tsv").write_text("name\turl\nx\thttps://c.test/\n")
    read = lambda s: sorted(r.domain for r in tabular.read_domains(spark, s).collect())
    assert read(str(tmp_path / "l.txt")) == ["a.test", "b.test"]
    assert read(str(tmp_path / "l.tsv")) == ["https://c.test/"]
    assert read("a.test, b.test c.test") == ["a.test", "b.test", "c.test"]
    assert tabular.candidates(tabular.read_domains(spark, "www.a.test, nothing"), "domain").count() == 1


def test_required_lists(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        tabular.save_required(spark.createDataFrame([], "domain string"), str(tmp_path / "p"))
    with pytest.raises(ValueError, match="no list"):
        tabular.load_required(spark, str(tmp_path / "p"))
    assert tabular.load_required(spark, str(tmp_path / "p"), required=False) is None
    tabular.save_required(spark.createDataFrame([("a.test",)], "domain string"), str(tmp_path / "p"))
    assert tabular.load_required(spark, str(tmp_path / "p")).count() == 1


def test_cache_and_html(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.json").write_text('{"url": "https://a.test/", "status": 200, "text": "hi"}')
    (tmp_path / "c" / "2.json").write_text("{broken")
    got = captured.read_cache(spark, str(tmp_path / "c")).collect()
    assert [(r.url, r.status) for r in got] == [("https://a.test/", 200)]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.jsonl").write_text('{"url": "https://a.test/"}\n{"url": "https://b.test/"}\nbroken\n')
    (tmp_path / "l" / "b.json").write_text('{\n "url": "https://c.test/"\n}')
    assert {r.url for r in captured.read_cache(spark, str(tmp_path / "l")).collect()} == {"https://a.test/", "https://b.test/", "https://c.test/"}
    (tmp_path / "s.html").write_text("<p>x</p>\n<p>y</p>")
    assert captured.read_saved_html(spark, str(tmp_path / "*.html")).first().html.count("<p>") == 2
    body = spark.createDataFrame([(bytearray("é".encode("latin-1")), "text/html; charset=ISO-8859-1"), (bytearray("é".encode()), None), (bytearray(b"x"), "image/png")], "b binary, c string")
    assert [r[0] for r in body.select(captured.decode_page(F.col("b"), F.col("c"))).collect()] == ["é", "é", None]
    more = [("мир", "cp1251", "text/html; charset=windows-1251"), ("łąka", "iso8859-2", 'text/html; charset="ISO-8859-2"'), ("é", "latin-1", None), ("ü", "utf-8-sig", "text/html; charset=latin-1"), ("ü", "utf-16", None)]
    rows = spark.createDataFrame([(i, bytearray(t.encode(c)), h) for i, (t, c, h) in enumerate(more)], "i int, b binary, c string")
    assert [r[0] for r in rows.orderBy("i").select(captured.decode_page(F.col("b"), F.col("c"))).collect()] == [t for t, _, _ in more]


def test_json_and_paste(spark):
    tree = '{"a":[{"name":"Elm","website":"https://elm.test/x"},{"deep":{"title":"Oak","url":""}}],"b":{"url":"https://facebook.com/p","name":"F"}}'
    df = spark.createDataFrame([(1, tree), (2, "no json"), (3, None)], "i bigint, t string")
    assert {(r.row, r.name, r.domain) for r in captured.json_pairs(df, "i", "t").collect()} == {(1, "Elm", "elm.test"), (1, "Oak", None), (1, "F", None)}
    page = (
        '<script id="__NEXT_DATA__">{"p":[{"company_name":"Ash","web_site":"ash.test"}]}</script><script>window.__NUXT__ = {"x":{"partner_name":"Fir","partner_url":"https://fir.test/"}};</script>'
        '<a href="https://yew.test/a"><b>Yew</b></a><a href="https://google.com/">G</a>'
    )
    both = spark.createDataFrame([(1, page), (2, tree)], "i bigint, t string")
    got = {(r.row, r.name, r.domain) for r in captured.captured_pairs(both, "i", "t").collect()}
    assert got == {(1, "Ash", "ash.test"), (1, "Fir", "fir.test"), (1, "Yew", "yew.test"), (2, "Elm", "elm.test"), (2, "Oak", None), (2, "F", None)}
    paste = spark.createDataFrame([("we found these\nthis week\nin town\nby foot\nhttps://r.com/?url=https://elm.com/\nand oak.agency but not x.test",), ("a.test\nb.test\na.test\nfacebook.com",), (None,)], "t string")
    assert [r[0] for r in paste.select(captured.pasted_domains(F.col("t"))).collect()] == [["elm.com", "r.com", "oak.agency"], ["a.test", "b.test"], None]


def test_state(tmp_path):
    p = str(tmp_path / "d" / "s.json")
    assert state.load_state(p, {"done": []}) == ({"done": []}, "")
    state.save_json({"done": [1]}, p)
    assert state.load_state(p, {"done": [], "x": 1})[0] == {"done": [1], "x": 1}
    (tmp_path / "d" / "s.json").write_text("{")
    assert "unreadable" in state.load_state(p, {})[1]
    with pytest.raises(RuntimeError):
        state.load_rules(p, {})


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from orgweave.staging import shared_dir

    conf = N(get=lambda *a: None)
    with pytest.raises(RuntimeError, match="share"):
        shared_dir(N(conf=conf, sparkContext=N(getConf=lambda: conf, master="spark://x:7077")))


def test_stages(spark):
    from pathlib import Path

    from orgweave.staging import clean, shared_dir, stage

    df = stage(spark.range(5).withColumn("s", F.lit("x")), "t")
    assert df.count() == 5 and df.columns == ["id", "s"]
    at = Path(shared_dir(spark).removeprefix("file://")) / "orgweave"
    other = at / "another-application"
    other.mkdir(parents=True)
    assert any((at / spark.sparkContext.applicationId).iterdir())
    clean(spark)
    assert not (at / spark.sparkContext.applicationId).exists() and other.exists()
    assert stage(spark.range(0)).count() == 0
