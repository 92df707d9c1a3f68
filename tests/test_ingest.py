"""XML and delimited-file ingest round trips, and the table sinks."""

import pytest
import os
import tempfile

from pyspark.sql import types as T

from riskflow.plans.ingest import combine_delimited, xml_codes, xml_column_codes
from riskflow.sources.sinks import append_unseen, read_table, replace_table
from riskflow.sources.xmldocs import node_count, read_documents


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_xml_directory_one_document_per_file(spark):
    d = tempfile.mkdtemp(prefix="rf-xml-")
    # default namespace, nested codes
    _write(d, "a.xml", '<?xml version="1.0"?>\n<report xmlns="urn:a"><userRefNumber>A1'
                       '</userRefNumber><code>01</code><x><code>02</code></x></report>')
    # Another file with a prefixed namespace
    _write(d, "b.xml", '<p:report xmlns:p="urn:b"><p:userRefNumber>B2</p:userRefNumber>'
                       '<p:code>03</p:code></p:report>')
    # A document with exactly one code keeps it
    _write(d, "c.xml", "<report><userRefNumber>C3</userRefNumber><code>04</code></report>")
    got = sorted(tuple(r) for r in xml_codes(spark, d).collect())
    assert got == [("01", "A1"), ("02", "A1"), ("03", "B2"), ("04", "C3")]
    docs = read_documents(spark, d)
    counts = sorted(r[0] for r in docs.select(node_count(docs["doc"], "//*[local-name()='code']"))
                    .collect())
    assert counts == [1, 1, 2]


def test_xml_column_under_root_only(spark):
    df = spark.createDataFrame(
        [(1, '<ns:creditBureau xmlns:ns="urn:t"><ns:code>AA</ns:code><ns:s><ns:code>BB'
             '</ns:code></ns:s></ns:creditBureau>'),
         (2, "<other><code>ZZ</code></other>")], "id long, testxml string")
    got = sorted(tuple(r) for r in xml_column_codes(df).collect())
    assert got == [("AA", 1), ("BB", 1)]


def test_delimited_folder_each_file_once(spark):
    # Two files, each row exactly once
    d = tempfile.mkdtemp(prefix="rf-tsv-")
    _write(d, "part1.txt", "1\tx\t2.5\n2\ty\t3.5\n")
    _write(d, "part2.txt", "3\tz\t4.5\n")
    df = combine_delimited(spark, d, (T.LongType(), T.StringType(), T.DoubleType()))
    assert df.columns == ["V1", "V2", "V3"]
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x", 2.5), (2, "y", 3.5),
                                                     (3, "z", 4.5)]


def test_replace_and_append_unseen(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="rf-tbl-"), "list")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "approvalbkey long, v string")
    replace_table(first, path)
    new = spark.createDataFrame([(2, "b2"), (3, "c")], "approvalbkey long, v string")
    assert append_unseen(new, path, "approvalbkey") == 1
    rows = sorted(tuple(r) for r in read_table(spark, path).collect())
    assert rows == [(1, "a"), (2, "b"), (3, "c")]


def test_csv_exports(spark):
    from riskflow.plans.ingest import delimited_folder_to_csv, xml_folder_to_csv
    d = tempfile.mkdtemp(prefix="rf-exp-")
    src = os.path.join(d, "xml")
    os.makedirs(src)
    _write(src, "r.xml", "<r><userRefNumber>7</userRefNumber><code>AB</code></r>")
    out = os.path.join(d, "codes_csv")
    xml_folder_to_csv(spark, src, out)
    back = spark.read.option("header", "true").csv(out)
    assert back.columns == ["CODE", "ID"] and [tuple(r) for r in back.collect()] == [("AB", "7")]
    tsv = os.path.join(d, "tsv")
    os.makedirs(tsv)
    _write(tsv, "a.txt", "1\tx\n")
    _write(tsv, "b.txt", "2\ty\n")
    out2 = os.path.join(d, "combined_csv")
    delimited_folder_to_csv(spark, tsv, (T.LongType(), T.StringType()), out2)
    text = "".join(open(os.path.join(out2, f)).read() for f in sorted(os.listdir(out2))
                   if f.endswith(".csv"))
    assert '"1","x"' in text and '"2","y"' in text


def test_store_list_refresh_then_append(spark):
    from riskflow.plans.collections import store_list
    path = os.path.join(tempfile.mkdtemp(prefix="rf-list-"), "buyout_collection_list")
    day1 = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01")],
                                 "approvalbkey long, added_to_list_date string")
    day2 = spark.createDataFrame([(2, "2024-01-02"), (3, "2024-01-02")],
                                 "approvalbkey long, added_to_list_date string")
    assert store_list(day1, path, full_refresh=True) == 2
    assert store_list(day2, path) == 1
    rows = sorted(tuple(r) for r in read_table(spark, path).collect())
    assert rows == [(1, "2024-01-01"), (2, "2024-01-01"), (3, "2024-01-02")]


TRICKY = [
    '<r xmlns="u"><userRefNumber>1</userRefNumber><code>A</code><x><code>B</code></x></r>',
    '<p:r xmlns:p="u"><p:userRefNumber>2</p:userRefNumber><p:code>C</p:code></p:r>',
    '<r><userRefNumber>3</userRefNumber><code>a&amp;b</code><code><![CDATA[<x>]]></code></r>',
    '<r><!-- <code>no</code> --><userRefNumber>4</userRefNumber><code>D</code></r>',
    '<r><userRefNumber>5</userRefNumber><code type="t">E</code><code/><code> </code></r>',
    '<r><userRefNumber>6</userRefNumber><code>F<b/>G</code><codes>no</codes><code></code></r>',
    '<?xml version="1.0"?><r><userRefNumber>7</userRefNumber><code>H&gt;</code></r>',
    '<r><userRefNumber>8</userRefNumber><code>été</code><code>I</code></r>',
    '<r><userRefNumber><n>9</n></userRefNumber><userRefNumber>10</userRefNumber></r>',
]


def test_fast_path_equals_xpath(spark):
    from riskflow.sources.xmldocs import shred
    docs = spark.createDataFrame([(i, d) for i, d in enumerate(TRICKY)], "i int, doc string")

    def run(engine):
        return sorted(tuple(r) for r in shred(docs, "doc", "code", "CODE", {"ID": "userRefNumber"},
                                              keep=("i",), engine=engine).collect())
    assert run("plain") == run("xpath")
    col = docs.withColumnRenamed("doc", "testxml").withColumnRenamed("i", "id")
    col = col.union(spark.createDataFrame([(99, "<other><code>Z</code></other>"),
                                           (98, "<creditBureau><code>Y</code></creditBureau>")],
                                          "id int, testxml string"))
    fast = sorted(tuple(r) for r in xml_column_codes(col, root="creditBureau", engine="plain").collect())
    slow = sorted(tuple(r) for r in xml_column_codes(col, root="creditBureau",
                                                     engine="xpath").collect())
    assert fast == slow == [("Y", 98)]


def test_default_reads_every_document_exactly(spark):
    # what a text search would get wrong: a leading processing instruction, CRLF, a cut-off document
    from riskflow.sources.xmldocs import shred
    docs = spark.createDataFrame([("<?foo x?><creditBureau><code>A</code></creditBureau>",),
                                  ("<creditBureau><code>a\r\nb</code></creditBureau>",)], "doc string")
    got = sorted(r.CODE for r in shred(docs, "doc", "code", "CODE", root="creditBureau").collect())
    assert got == ["A", "a\nb"]
    cut = spark.createDataFrame([("<creditBureau><code>A</code><code>B",)], "doc string")
    with pytest.raises(Exception):
        shred(cut, "doc", "code", "CODE", root="creditBureau").collect()


def test_codes_are_kept_whole_unless_a_width_is_given(spark):
    long = "x" * 50
    col = spark.createDataFrame([(1, f"<creditBureau><code>{long}</code></creditBureau>")], "id int, testxml string")
    assert [r.code for r in xml_column_codes(col).collect()] == [long]
    assert [r.code for r in xml_column_codes(col, width=32).collect()] == [long[:32]]


def test_prefixed_reports_take_the_fast_path(spark):
    from pyspark.sql import functions as F

    from riskflow.sources.xmldocs import simple_form
    docs = spark.createDataFrame(
        [('<ns:r xmlns:ns="u"><ns:code>A</ns:code><ns:x><ns:code>B</ns:code></ns:x></ns:r>',),
         ('<r xmlns="u"><code>A</code><x><code>B</code></x></r>',),
         ("<r><code>A<b/></code></r>",)], "doc string")
    got = [r[0] for r in docs.select(simple_form(F.col("doc"), ["code"])).collect()]
    assert got == [True, True, False]


MIXED = [
    (1, '<c:creditBureau xmlns:c="u" xmlns="v"><code>foreign</code><c:code>0<!-- x -->2</c:code><c:code/></c:creditBureau>'),
    (2, '<creditBureau xmlns="u"><code>a<b/>c</code><code> \n </code><code><![CDATA[<x>]]>y</code></creditBureau>'),
    (3, '<creditBureau><code>none</code></creditBureau>'),
    (4, '<?xml version="1.0" encoding="UTF-16"?><?pi x?>\r\n<c:creditBureau xmlns:c="u"><c:code>p\r\nq</c:code></c:creditBureau>'),
    (5, '<c:other xmlns:c="u"><c:code>no</c:code></c:other>'),
    (6, None),
]


def test_names_are_bound_to_one_namespace_and_texts_are_first_or_each(spark):
    from riskflow.sources.xmldocs import shred
    docs = spark.createDataFrame(MIXED, "id int, testxml string")

    def run(**how):
        return sorted(((r.id, r.code) for r in xml_column_codes(docs, **how).collect()), key=str)
    assert run(namespace="u", texts="first") == sorted(
        [(1, "0"), (1, None), (2, "a"), (2, None), (2, "<x>y"), (4, "p\nq")], key=str)
    assert run(namespace="u") == sorted([(1, "0"), (1, "2"), (2, "a"), (2, "c"), (2, " \n "), (2, "<x>y"), (4, "p\nq")], key=str)
    assert run(namespace="") == [(3, "none")]
    assert (1, "foreign") in run() and (3, "none") in run()
    keyed = spark.createDataFrame([('<r xmlns="u"><k xmlns="v">other</k><a>1</a><k><n>no</n></k><k>yes</k><a>2</a></r>',)], "doc string")
    got = shred(keyed, "doc", "a", "A", {"K": "k", "M": "missing"}, namespace="u").collect()
    assert [(r.A, r.K, r.M) for r in got] == [("1", "yes", ""), ("2", "yes", "")]


@pytest.mark.parametrize("doc", ["<r><code>A</code>", "", "<r><a></r></a>", "<r>&nope;</r>", "<x:r><code>A</code></x:r>", "<r/><r/>"])
def test_documents_that_are_not_well_formed_raise(spark, doc):
    from riskflow.sources.xmldocs import profile
    docs = spark.createDataFrame([(1, doc)], "id int, testxml string")
    with pytest.raises(Exception, match="well-formed"):
        xml_column_codes(docs).collect()
    with pytest.raises(Exception, match="well-formed"):
        profile(docs, "testxml").collect()


def test_one_parse_equals_xpath_where_both_apply(spark):
    from riskflow.sources.xmldocs import shred
    docs = spark.createDataFrame([(i, d) for i, d in enumerate(TRICKY)], "i int, doc string")

    def run(engine):
        return sorted(tuple(r) for r in shred(docs, "doc", "code", "CODE", {"ID": "userRefNumber"}, keep=("i",), engine=engine).collect())
    assert run("parse") == run("xpath")
    with pytest.raises(ValueError):
        shred(docs, "doc", "code", "CODE", engine="xpath", namespace="u")


def test_profile_merges_over_tasks(spark):
    from riskflow.sources.xmldocs import profile
    docs = [('<r a="1"><x>t</x><x/></r>',), ('<r b="2" a="3"><x k="1"><y/> </x></r>',), (None,), ('<r xmlns="u"><x/></r>',)]
    got = {r.path: r for r in profile(spark.createDataFrame(docs, "doc string").repartition(4)).collect()}
    assert set(got) == {"/r", "/r/x", "/r/x/y", "/{u}r", "/{u}r/{u}x"}
    r, x = got["/r"], got["/r/x"]
    assert (r.documents, r.occurrences, r.least_children, r.most_children, r.texts, r.attributes, r.depth) == (2, 2, 1, 2, 0, "a,b", 1)
    assert (x.documents, x.occurrences, x.least_children, x.most_children, x.texts, x.attributes, x.depth) == (2, 3, 0, 1, 1, "k", 2)
    assert got["/{u}r/{u}x"].depth == 2
    assert profile(spark.createDataFrame([], "doc string")).count() == 0


def test_declared_namespace_is_the_first_files(spark):
    from riskflow.sources.xmldocs import declared_namespace
    d = tempfile.mkdtemp(prefix="rf-ns-")
    _write(d, "b.xml", '<r xmlns="urn:second"/>')
    _write(d, "a.xml", '<p:r xmlns:p="urn:first"/>')
    assert declared_namespace(read_documents(spark, d)) == "urn:first"


def test_reports_one_to_a_file_lie_in_one_folder(spark, tmp_path, monkeypatch):
    # a folder for every report is what listing and committing cannot bear when there are many
    from riskflow import catalog
    monkeypatch.setattr(catalog, "scratch_folder", lambda session, name: str(tmp_path / name))
    sf = "/root/testdata/sf0.001"
    catalog.q_xml_files_csv(spark, sf).count()
    stored = [f for f in os.listdir(tmp_path / "xml-files") if not f.startswith((".", "_"))]
    assert not [f for f in stored if os.path.isdir(tmp_path / "xml-files" / f)]
    assert len(stored) == spark.read.parquet(f"{sf}/supplier.parquet").count()
