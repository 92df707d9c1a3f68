"""XML documents as rows: directory scans and XML columns, shredded by element name.

Documents stay strings and are shredded on the executors; ``explode`` turns repeated elements
into rows.

* ``engine='parse'`` (default): one parse of a document gives the repeated elements and the keys
  together (``xmlparse``). Elements are matched by local name in one ``namespace``, or in any.
  A document that is not well formed raises.
* ``engine='xpath'``: Spark's built-in ``xpath`` / ``xpath_string``, JVM only, which build a DOM per
  document per call and match local names in any namespace.
* ``engine='plain'`` is an explicit choice for collections known to be machine-written in a
  plain, well-formed style: a regex then reads documents that look like it and ``xpath`` the
  others. Unlike the default it does not notice a truncated document, a leading processing
  instruction or CRLF line ends. Documents count as plain if they are ASCII only, no ``<!`` (comments, CDATA, DOCTYPE),
  no ``&`` (entity/char references), no processing instruction after the start,
  and the target elements written as ``<name>text</...>`` or ``<p:name>text</...>``
  -- no attributes, whitespace or self-closing form in their tags, and no child
  elements inside them. A document outside that form goes through ``xpath``;
  ``CASE`` evaluates only the chosen branch per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.sources import xmlparse

PROFILE = ("path string, attribute string, documents long, occurrences long, least_children long, "
           "most_children long, texts long")
PROFILE_PATHS = 50_000      # a task hands over its counts beyond this many paths
_PREFIX = r"(?:[A-Za-z_][\w.-]*:)?"


def by_name(*names: str, root: bool = False) -> str:
    """Namespace-agnostic XPath: ``by_name('creditBureau', 'code')`` ->
    ``//*[local-name()='creditBureau']//*[local-name()='code']``."""
    steps = "".join(f"//*[local-name()='{n}']" for n in names)
    return steps[1:] if root else steps


def read_documents(spark: SparkSession, path: str, one_per_file: bool = True,
                   recursive: bool = False) -> DataFrame:
    """Scan a directory of XML documents -> (file, doc).

    one_per_file=True: each file is one document (``wholetext``); the scan is
    split by file across tasks. one_per_file=False: one document per line
    (large collections packed into few files), split by file blocks.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    df = reader.text(path, wholetext=one_per_file)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc"))


def _open_tag(name: str) -> str:
    return "<" + _PREFIX + name


def simple_form(doc: Column, names) -> Column:
    """Does the document look plain for elements ``names``?

    Built from cheap tests (substring search, char vs byte length) and one short
    regex per element; a false "not simple" only sends the document to ``xpath``.
    """
    ok = ((F.length(doc) == F.octet_length(doc))           # ASCII only
          & ~doc.contains("<!") & ~doc.contains("&")        # no comment/CDATA/DOCTYPE/refs
          & (F.locate("<?", doc, 2) == 0))                  # no PI after the start
    for n in names:
        # tag with attributes/blanks/self-closing, or a child element inside it
        ok = ok & ~doc.rlike(_open_tag(n) + r"(?:[\s/]|>[^<]*<[^/])")
    return ok


def _root_is(doc: Column, root: str) -> Column:
    return doc.rlike(r"^(?:<\?xml[^>]*\?>)?\s*" + _open_tag(root) + r"[\s>/]")


def element_texts(doc: Column, name: str, root: str | None = None,
                  engine: str = "xpath") -> Column:
    """JVM engines: array of the text of every ``name`` element (under the root ``root`` if given)."""
    xp = (by_name(root, root=True) if root else "") + by_name(name) + "/text()"
    exact = F.xpath(doc, F.lit(xp))
    if engine == "xpath":
        return exact
    if engine != "plain":
        raise ValueError(engine)
    fast = F.regexp_extract_all(doc, F.lit(_open_tag(name) + ">([^<]+)</"), F.lit(1))
    simple = simple_form(doc, [name])
    if not root:
        return F.when(simple, fast).otherwise(exact)
    # the root's own tag may carry attributes (namespace declarations): only its
    # name is checked; the simple-form rules apply to the shredded element.
    # One flat CASE (a nested one made Spark evaluate the xpath branch eagerly).
    return (F.when(simple & _root_is(doc, root), fast)
             .when(simple, F.array().cast("array<string>"))
             .otherwise(exact))


def first_text(doc: Column, name: str, engine: str = "xpath") -> Column:
    """String value of the first ``name`` element in document order ('' when none)."""
    exact = F.xpath_string(doc, F.lit(by_name(name)))
    if engine == "xpath":
        return exact
    fast = F.regexp_extract(doc, _open_tag(name) + ">([^<]*)</", 1)
    return F.when(simple_form(doc, [name]), fast).otherwise(exact)


def shred(docs: DataFrame, doc_col: str, element: str, value_name: str,
          scalars: dict[str, str] | None = None, root: str | None = None,
          keep: tuple[str, ...] = (), engine: str = "parse",
          namespace: str | None = xmlparse.ANY, texts: str = "each") -> DataFrame:
    """One row per text of ``element``, with the first text of each scalar element repeated on
    every row of the document ('' where it has none).

    ``namespace`` binds all names, the root's included, to one URI ('' for none); by default any
    matches. ``texts='each'`` gives a row for every text node (``//element/text()``), ``'first'`` one for
    every element: its first text node that is not blank, or NULL. Both need the default engine
    where they differ from the default. A null document gives no rows.
    """
    scalars, d = scalars or {}, F.col(doc_col)
    if texts not in ("each", "first"):
        raise ValueError(texts)
    if engine != "parse":
        if namespace is not xmlparse.ANY or texts != "each":
            raise ValueError(f"engine {engine!r} binds no namespace and knows no first text")
        cols = {name: first_text(d, el, engine) for name, el in scalars.items()}
        return docs.select(*keep, *[c.alias(n) for n, c in cols.items()],
                           F.explode(element_texts(d, element, root, engine)).alias(value_name))
    read = xmlparse.shredded(element, list(scalars.values()), root, namespace, texts == "each")
    found = docs.select(*keep, read(d).alias("_found"))
    # an outer explode: the plain one has a filter inferred below it, which would parse every document twice
    rows = found.select(*keep, *[F.get("_found.scalars", F.lit(i)).alias(n) for i, n in enumerate(scalars)],
                        F.posexplode_outer("_found.values").alias("_place", value_name))
    return rows.filter("_place is not null").drop("_place")


def declared_namespace(docs: DataFrame, file_col: str = "file", doc_col: str = "doc") -> str:
    """The namespace of the first file's root element ('' if it has none): what binds the
    names of a whole directory where every file declares the same."""
    first = docs.orderBy(file_col).select(doc_col).limit(1).collect()
    return xmlparse.root_name(first[0][0]).rpartition("}")[0] if first else ""


def profile(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Structure of a whole collection: one row per element path.

    path (``/{uri}name/...``), documents that have it, occurrences, the least and most children of
    one, how many hold text, and its attributes' names. Every task counts its own documents;
    the shuffle merges one row per path and task.
    """
    def count(batches):
        names = [c.split()[0] for c in PROFILE.split(", ")]
        mine = xmlparse.Profile()
        for batch in batches:
            for doc in batch[doc_col]:
                if doc is not None:
                    mine.add(doc)
                if len(mine.paths) > PROFILE_PATHS:
                    yield _frame(mine.rows(), names)
                    mine = xmlparse.Profile()
        yield _frame(mine.rows(), names)

    parts = docs.select(doc_col).mapInPandas(count, PROFILE)
    merged = parts.groupBy("path", "attribute").agg(
        F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences"),
        F.min("least_children").alias("least_children"), F.max("most_children").alias("most_children"), F.sum("texts").alias("texts"))
    element = F.col("attribute").isNull()
    own = {c: F.max(F.when(element, F.col(c))).alias(c) for c in ("documents", "occurrences", "least_children", "most_children", "texts")}
    return (merged.groupBy("path").agg(
        *own.values(), F.array_join(F.array_sort(F.collect_list("attribute")), ",").alias("attributes"))
        .withColumn("depth", F.size(F.split(F.regexp_replace("path", r"\{[^}]*\}", ""), "/")) - 1))


def _frame(rows: list[tuple], names: list[str]):
    import pandas as pd
    return pd.DataFrame(rows, columns=names).astype({"least_children": "Int64", "most_children": "Int64"})


def node_count(doc: Column, xpath: str) -> Column:
    """Structural profile helper: number of nodes matching ``xpath``."""
    return F.xpath_int(doc, F.lit(f"count({xpath})"))
