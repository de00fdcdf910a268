from scholia.sources import records


def test_csv_sources(spark, tmp_path):
    (tmp_path / "nodes.csv").write_text('id,title,abstract\n1,"A ""quoted"" title","two\nlines"\n,x,y\n3,z,\n')
    rows = records.citation_csv(spark, str(tmp_path / "nodes.csv")).collect()
    assert rows[0]["abstract"] == "two\nlines" and rows[0]["title"] == 'A "quoted" title' and len(rows) == 3
    (tmp_path / "dois.csv").write_text("DOI,note\n10.1/a,x\n,y\n10.1/b,\n")
    assert [r["doi"] for r in records.first_column(spark, str(tmp_path / "dois.csv")).collect()] == ["10.1/a", "10.1/b"]


def test_json_files(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"C1": ["name", "OTf", "x"],\n "C2": ["short"], "C3": ["name", "OTs"]}')
    rows = records.json_map(records.json_documents(spark, str(tmp_path / "map.json"))).collect()
    assert [tuple(r) for r in rows] == [("C1", "name", "OTf"), ("C3", "name", "OTs")]


def test_first_existing_source(spark):
    one = lambda n: spark.createDataFrame([(i,) for i in range(n)], "v int")
    assert records.first_source(one(2), one(5)).count() == 2
    assert records.first_source(one(0), one(5)).count() == 5


def test_work_record_without_fields(spark):
    df = spark.createDataFrame([('{"DOI": "10.1/x", "author": [{"name": "Group"}], "reference": [{}, {"DOI": "10.1/y"}]}',), ("{}",)], "value string")
    a, b = records.flatten_work(df).collect()
    assert (a["title"], a["author"], a["year"], a["citations"], a["references"]) == ("No Title", "Group", None, 0, ["10.1/y"])
    assert (b["doi"], b["author"], b["references"]) == (None, "Unknown", [])
