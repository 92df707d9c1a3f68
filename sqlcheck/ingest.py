"""Oracle SQL: XML shredding and delimited-file combine, stated over the source rows."""

SQL = {
    "xml_codes": """
SELECT l_returnflag || l_linestatus AS CODE, CAST(l_orderkey AS VARCHAR) AS ID FROM lineitem
UNION ALL
SELECT l_returnflag, CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_linenumber > 1
UNION ALL
SELECT l_linestatus, CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_linenumber > 1""",
    "xml_files_csv": """
SELECT 'N' || s_nationkey AS CODE, CAST(s_suppkey AS VARCHAR) AS ID FROM supplier
UNION ALL
SELECT 'X & Y', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 3 = 0""",
    "xml_column_codes": """
SELECT l_returnflag || l_linestatus AS code, l_orderkey AS id FROM lineitem
UNION ALL
SELECT l_returnflag, l_orderkey FROM lineitem WHERE l_linenumber > 1""",
    "xml_bound_codes": """
SELECT '0' AS code, o_orderkey AS id FROM orders WHERE o_orderkey % 11 <> 0
UNION ALL
SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'A&B' END, o_orderkey FROM orders WHERE o_orderkey % 11 <> 0""",
    "xml_profile": """
WITH o AS (SELECT *, '/{http://example.com/credit}' || CASE WHEN o_orderkey % 11 = 0 THEN 'archive' ELSE 'creditBureau' END AS root
           FROM orders),
l AS (SELECT row_number() OVER () AS r, l_linenumber FROM lineitem),
seen AS (
    SELECT root AS path, 4 AS children, 0 AS texts, 1 AS n, o_orderkey AS doc, 'version' AS attributes FROM o
    UNION ALL SELECT root || '/{http://example.com/other}code', 0, 1, 1, o_orderkey, '' FROM o
    UNION ALL SELECT root || '/{http://example.com/credit}subject', 1, 0, 1, o_orderkey, 'seq,{http://example.com/credit}kind' FROM o
    UNION ALL SELECT root || '/{http://example.com/credit}subject/{http://example.com/credit}userRefNumber', 0, 1, 1, o_orderkey, '' FROM o
    UNION ALL SELECT root || '/{http://example.com/credit}code', 0, 1, 1, o_orderkey, '' FROM o
    UNION ALL SELECT root || '/{http://example.com/credit}code', 0, 0, 1, o_orderkey, '' FROM o WHERE o_orderkey % 3 = 0
    UNION ALL SELECT root || '/{http://example.com/credit}alerts', 1, 0, 1, o_orderkey, 'n' FROM o WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT root || '/{http://example.com/credit}alerts/{http://example.com/credit}code', 1, 1, 1, o_orderkey, '' FROM o WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT root || '/{http://example.com/credit}alerts/{http://example.com/credit}code/{http://example.com/credit}note', 0, 1, 1, o_orderkey, ''
              FROM o WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT '/{http://example.com/credit}creditBureau', CASE WHEN l_linenumber > 1 THEN 2 ELSE 1 END, 0, 1, -r, '' FROM l
    UNION ALL SELECT '/{http://example.com/credit}creditBureau/{http://example.com/credit}code', 0, 1, 1, -r, '' FROM l
    UNION ALL SELECT '/{http://example.com/credit}creditBureau/{http://example.com/credit}alerts', 1, 0, 1, -r, '' FROM l WHERE l_linenumber > 1
    UNION ALL SELECT '/{http://example.com/credit}creditBureau/{http://example.com/credit}alerts/{http://example.com/credit}alert', 1, 0, 1, -r, ''
              FROM l WHERE l_linenumber > 1
    UNION ALL SELECT '/{http://example.com/credit}creditBureau/{http://example.com/credit}alerts/{http://example.com/credit}alert/{http://example.com/credit}code', 0, 1, 1,
              -r, '' FROM l WHERE l_linenumber > 1)
SELECT path, count(DISTINCT doc) AS documents, sum(n)::BIGINT AS occurrences, min(children)::BIGINT AS least_children,
       max(children)::BIGINT AS most_children, sum(texts)::BIGINT AS texts, max(attributes) AS attributes,
       (length(replace(path, 'http://example.com/', '')) - length(replace(replace(path, 'http://example.com/', ''), '/', '')))::INTEGER AS depth
FROM seen GROUP BY path""",
    "combine_tsv": """
SELECT s_suppkey AS V1, s_name AS V2, s_nationkey AS V3, s_acctbal AS V4 FROM supplier""",
    # both a field short and one too many make four fields of which the last is no number
    "combine_tsv_sound": """
SELECT s_suppkey AS V1, s_name AS V2, s_nationkey AS V3, s_acctbal AS V4 FROM supplier
WHERE s_suppkey % 7 <> 3 AND s_suppkey % 5 <> 2 AND s_suppkey % 11 <> 4""",
    "tsv_malformed": """
SELECT concat_ws(chr(9), s_suppkey::VARCHAR, s_name, CASE WHEN s_suppkey % 7 = 3 THEN 'many' ELSE s_nationkey::VARCHAR END,
                 CASE WHEN s_suppkey % 5 <> 2 THEN s_acctbal::VARCHAR END, CASE WHEN s_suppkey % 11 = 4 THEN 'more' END) AS line
FROM supplier WHERE s_suppkey % 7 = 3 OR s_suppkey % 5 = 2 OR s_suppkey % 11 = 4""",
}
