"""The dataset catalog, names that a query reads, and tables of databases."""

import zipfile
from datetime import datetime

import pytest

from plumbline.plans.catalyst import relations
from plumbline.sources import readers
from plumbline.sources.catalog import Catalog
from plumbline.sources.readers import Datasets, key_ranges, read, read_jdbc
from plumbline.sources.sheets import read_excel


@pytest.mark.parametrize(
    "query, names",
    [
        ("SELECT * FROM orders", {"orders"}),
        ("SELECT 'users' AS kind FROM orders -- users\n/* users */", {"orders"}),
        ("SELECT users.x, users FROM orders users", {"orders"}),
        ("SELECT * FROM Orders o JOIN users u ON o.id = u.id, nation", {"Orders", "users", "nation"}),
        ("WITH users AS (SELECT * FROM people) SELECT * FROM users", {"people"}),
        ("WITH users AS (SELECT * FROM users) SELECT * FROM users", {"users"}),
        ("WITH a AS (SELECT * FROM t1), b AS (SELECT * FROM a JOIN t2) SELECT * FROM b", {"t1", "t2"}),
        ("SELECT * FROM (WITH a AS (SELECT 1) SELECT * FROM a) x JOIN a", {"a"}),
        ("SELECT (SELECT max(x) FROM t1), id IN (SELECT id FROM t2) FROM t3 WHERE EXISTS (SELECT 1 FROM t4 WHERE t4.x = t3.x)", {"t1", "t2", "t3", "t4"}),
        ("WITH a AS (SELECT 1) SELECT * FROM t WHERE x IN (SELECT x FROM a) UNION SELECT * FROM u", {"t", "u"}),
        ("SELECT * FROM t1, LATERAL (SELECT * FROM t2 WHERE t2.x = t1.x)", {"t1", "t2"}),
        ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r JOIN t", {"t"}),
        ("SELECT * FROM db.orders", {"db.orders"}),
        ("SELECT 1", set()),
    ],
)
def test_relations(spark, query, names):
    assert {".".join(parts) for parts in relations(spark, query)} == names


def test_named_views(spark, tmp_path):
    (tmp_path / "users.csv").write_text("a,b\n1,2\n")
    sets = Datasets(spark)
    sets.add(str(tmp_path / "users.csv"))
    assert sets.referenced("SELECT 'users' AS kind FROM orders") == [] and sets.referenced("SELECT * FROM Users") == ["users"]


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/catalog", most_bytes=1000)


def test_catalog(spark, tmp_path, catalog):
    (tmp_path / "Q3 Sales.csv").write_text("a,b\n1,x\n2,y\n")
    assert catalog.names() == [] and catalog.list().count() == 0
    assert catalog.put(f"{tmp_path}/Q3 Sales.csv") == "q3_sales"
    assert catalog.get("q3_sales").count() == 2
    about = catalog.list().first()
    assert (about["name"], about["file"], about["bytes"], about["columns"]) == ("q3_sales", "Q3 Sales.csv", 12, {"a": "int", "b": "string"})
    spark.range(7).write.parquet(f"file://{tmp_path}/seven.parquet")
    with pytest.raises(ValueError, match="limit"):
        Catalog(spark, catalog.folder, 100).put(f"file://{tmp_path}/seven.parquet")
    big = Catalog(spark, catalog.folder, 1 << 20)
    big.put(f"file://{tmp_path}/seven.parquet", "orders")
    assert big.names() == ["orders", "q3_sales"]
    assert big.referenced("SELECT 'q3_sales' FROM Orders") == ["orders"]
    assert big.sql("SELECT count(*) AS n FROM orders CROSS JOIN q3_sales").first()["n"] == 14
    big.delete("orders")
    assert big.names() == ["q3_sales"]
    with pytest.raises(KeyError):
        big.get("orders")


def test_replacing(tmp_path, catalog):
    file = tmp_path / "t.csv"
    file.write_text("a\n1\n")
    catalog.put(str(file))
    file.write_text("a\n1\n2\n")
    with pytest.raises(FileExistsError):
        catalog.put(str(file))
    catalog.put(str(file), replace=True)
    assert catalog.get("t").count() == 2 and len(list((tmp_path / "catalog" / "t").iterdir())) == 1


@pytest.mark.parametrize("at", ["copied", "described"])
def test_a_crash_leaves_the_old_one(spark, tmp_path, catalog, monkeypatch, at):
    file = tmp_path / "t.csv"
    file.write_text("a\n1\n")
    catalog.put(str(file))
    file.write_text("a\n1\n2\n3\n")

    def crash(*args, **kwargs):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr("plumbline.sources.catalog.read" if at == "copied" else "plumbline.sources.catalog.Catalog._write", crash)
        with pytest.raises(KeyboardInterrupt):
            catalog.put(str(file), replace=True)
    assert catalog.get("t").count() == 1 and catalog.names() == ["t"]
    # a machine that died has left a copy that was not renamed: nobody takes it for a dataset
    (tmp_path / "catalog" / "t" / "_coming-x").mkdir()
    (tmp_path / "catalog" / "half" / "_coming-y").mkdir(parents=True)
    assert catalog.get("t").count() == 1 and catalog.names() == ["t"]
    catalog.put(str(file), replace=True)
    assert catalog.get("t").count() == 3


@pytest.mark.parametrize("name", ["../x", "a/b", "", "1a", "x" * 101, "a b"])
def test_names_are_guarded(tmp_path, catalog, name):
    (tmp_path / "t.csv").write_text("a\n1\n")
    if name:
        with pytest.raises(ValueError):
            catalog.put(f"{tmp_path}/t.csv", name)
    with pytest.raises(ValueError):
        catalog.get(name)


def test_paths_are_guarded(tmp_path, catalog):
    with pytest.raises(ValueError, match="outside"):
        catalog.put(f"{tmp_path}/../t.csv")
    with pytest.raises(ValueError, match="outside"):
        catalog.put(f"{catalog.folder}/t/x.csv")
    with pytest.raises(FileNotFoundError):
        catalog.put(f"{tmp_path}/absent.csv")


URL, DRIVER = "jdbc:derby:memory:plumbline;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_jdbc(spark):
    """An embedded database: keys that crowd at one end are cut into parts of about as many rows."""
    df = spark.range(8000).selectExpr("IF(id < 7000, id, id * 50) AS k", "id AS v").union(spark.sql("SELECT CAST(NULL AS BIGINT), -1L"))
    df.coalesce(1).write.jdbc(URL, "numbers", "overwrite", {"driver": DRIVER})
    back = read_jdbc(spark, URL, "numbers", '"k"', 8, driver=DRIVER)
    sizes = [r[1] for r in back.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    assert sum(sizes) == 8001 and sorted(r["v"] for r in back.collect()) == [-1, *range(8000)]
    parts = key_ranges(spark, URL, "numbers", '"k"', 8, driver=DRIVER)
    assert len(parts) == back.rdd.getNumPartitions()
    narrow = key_ranges(spark, URL, "(SELECT * FROM numbers WHERE \"k\" < 7000) t", '"k"', 8, driver=DRIVER)
    counted = [read_jdbc(spark, URL, "numbers", driver=DRIVER).where("k < 7000 AND (" + p.replace('"', "`") + ")").count() for p in narrow]
    assert sum(counted) == 7000 and max(counted) <= 1.2 * 7000 / 8
    assert key_ranges(spark, URL, "(SELECT * FROM numbers WHERE \"k\" < 0) t", '"k"', 8, driver=DRIVER) == ["1 = 1"]
    assert read_jdbc(spark, URL, "numbers", driver=DRIVER).count() == 8001 and readers.FINE > 1


_MAIN, _REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_workbook(path, rows, sheet="Data"):
    """A workbook of two sheets, the first of which has only a title; a row is the XML of its cells."""
    body = "".join(f'<row r="{n}">{cells}</row>' for n, cells in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="Title" sheetId="1" r:id="rId1"/><sheet name="{sheet}" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}"><si><t>name</t></si><si><r><t>two </t></r><r><t>runs</t></r></si><si><t>when</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{_MAIN}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>title</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')


def test_spreadsheets(spark, tmp_path):
    head = '<c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="C1" t="s"><v>2</v></c><c r="E1" t="str"><v>ok</v></c>'
    rows = [
        (1, head),
        (2, '<c r="A2" t="s"><v>1</v></c><c r="B2"><v>5</v></c><c r="C2" s="1"><v>45292</v></c><c r="D2"><v>1.5</v></c><c r="E2" t="b"><v>1</v></c>'),
        (4, '<c r="B4"><v>-7</v></c><c r="C4" s="2"><v>45292.75</v></c><c r="E4" t="b"><v>0</v></c><c r="A4" t="e"><v>#N/A</v></c>'),
        (5, '<c r="A5"/>'),
    ]
    (tmp_path / "in").mkdir()
    write_workbook(tmp_path / "in" / "a.xlsx", rows)
    df = read_excel(spark, f"{tmp_path}/in/a.xlsx", "Data")
    assert dict(df.dtypes) == {"name": "string", "n": "bigint", "when": "timestamp_ntz", "c3": "double", "ok": "boolean"}
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("two runs", 5, datetime(2024, 1, 1), 1.5, True), (None, -7, datetime(2024, 1, 1, 18), None, False)], key=str)
    assert [tuple(r) for r in read_excel(spark, f"{tmp_path}/in/a.xlsx", header=False).collect()] == [("title",)]
    # a second file has the columns in another order
    write_workbook(tmp_path / "in" / "b.xlsx", [(1, '<c r="A1" t="str"><v>n</v></c><c r="B1" t="str"><v>name</v></c>'), (2, '<c r="A2"><v>2.5</v></c><c r="B2" t="str"><v>other</v></c>')])
    both = read_excel(spark, f"{tmp_path}/in", "Data")
    assert dict(both.dtypes)["n"] == "double" and sorted((r["name"] or "", r["n"]) for r in both.collect()) == [("", -7.0), ("other", 2.5), ("two runs", 5.0)]
    assert read(spark, f"{tmp_path}/in/a.xlsx").count() == 0 and read(spark, f"{tmp_path}/in/a.xlsx").columns == ["title"]
