"""Queries of the structure of pages: trees of blocks and their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.sources import blocks, rendered


def block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks of pages with nested lists, tables, quotes, figures and definitions."""
    found = blocks.blocks(rendered.structured_pages(spark, sf_dir))
    numbers = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("parent_idx", "depth", "number")]
    return found.select("page_id", "block_idx", *numbers, "node_type", "list_type", "text", "md", "language", "uri", "mime_type")


def structured_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and markdown of the same pages."""
    return blocks.documents(blocks.blocks(rendered.structured_pages(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (block_tree, structured_documents)}

#: For each shape (the remainder of the key by 4): block_idx, parent_idx, node_type, depth, list_type, number, text, md, language.
_TREE = r"""WITH p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS kind, p_size AS size FROM part), b AS (
    SELECT k, unnest([
        {'i': 0, 'up': NULL::INT, 'type': 'Heading', 'depth': 1, 'list': NULL::VARCHAR, 'n': NULL::INT, 'text': name, 'md': '# ' || name, 'lang': NULL::VARCHAR},
        {'i': 1, 'up': NULL, 'type': 'BulletList', 'depth': NULL, 'list': 'bullet', 'n': 1, 'text': '', 'md': '', 'lang': NULL},
        {'i': 2, 'up': 1, 'type': 'ListItem', 'depth': 1, 'list': 'bullet', 'n': 1, 'text': brand, 'md': '- ' || brand, 'lang': NULL},
        {'i': 3, 'up': 2, 'type': 'OrderedList', 'depth': NULL, 'list': 'ordered', 'n': size, 'text': '', 'md': '', 'lang': NULL},
        {'i': 4, 'up': 3, 'type': 'ListItem', 'depth': 2, 'list': 'ordered', 'n': size, 'text': kind, 'md': '  ' || size || '. ' || kind, 'lang': NULL},
        {'i': 5, 'up': 3, 'type': 'ListItem', 'depth': 2, 'list': 'ordered', 'n': size + 1, 'text': 'one', 'md': '  ' || (size + 1) || '. one', 'lang': NULL},
        {'i': 6, 'up': 5, 'type': 'Paragraph', 'depth': NULL, 'list': NULL, 'n': NULL, 'text': 'two', 'md': '    two', 'lang': NULL},
        {'i': 7, 'up': 1, 'type': 'ListItem', 'depth': 1, 'list': 'bullet', 'n': 2, 'text': size::VARCHAR, 'md': '- **' || size || '**', 'lang': NULL}
    ]) AS x FROM p WHERE k % 4 = 0
    UNION ALL SELECT k, unnest([
        {'i': 0, 'up': NULL::INT, 'type': 'Paragraph', 'depth': NULL::INT, 'list': NULL::VARCHAR, 'n': NULL::INT, 'text': 'before', 'md': 'before', 'lang': NULL::VARCHAR},
        {'i': 1, 'up': NULL, 'type': 'Table', 'depth': NULL, 'list': NULL, 'n': NULL,
            'text': 'brand | kind|size' || chr(10) || brand || ' | ' || kind || ' ' || size || chr(10) || k,
            'md': '| brand | kind\|size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || brand || ' | ' || kind || ' ' || size || ' |' || chr(10) || '| *' || k || '* |  |', 'lang': NULL},
        {'i': 2, 'up': 1, 'type': 'Caption', 'depth': NULL, 'list': NULL, 'n': NULL, 'text': name, 'md': name, 'lang': NULL}
    ]) FROM p WHERE k % 4 = 1
    UNION ALL SELECT k, unnest([
        {'i': 0, 'up': NULL::INT, 'type': 'BlockQuote', 'depth': NULL::INT, 'list': NULL::VARCHAR, 'n': NULL::INT, 'text': '', 'md': '', 'lang': NULL::VARCHAR},
        {'i': 1, 'up': 0, 'type': 'Paragraph', 'depth': NULL, 'list': NULL, 'n': NULL, 'text': name, 'md': '> ' || name, 'lang': NULL},
        {'i': 2, 'up': 0, 'type': 'BlockQuote', 'depth': NULL, 'list': NULL, 'n': NULL, 'text': '', 'md': '', 'lang': NULL},
        {'i': 3, 'up': 2, 'type': 'Paragraph', 'depth': NULL, 'list': NULL, 'n': NULL, 'text': brand || ' ' || size, 'md': '> > ' || brand || ' ' || size, 'lang': NULL},
        {'i': 4, 'up': NULL, 'type': 'Figure', 'depth': NULL, 'list': NULL, 'n': NULL, 'text': '', 'md': '', 'lang': NULL},
        {'i': 5, 'up': 4, 'type': 'Paragraph', 'depth': NULL, 'list': NULL, 'n': NULL, 'text': '', 'md': '![' || kind || '](https://e.example.com/i/' || k || '.png)', 'lang': NULL},
        {'i': 6, 'up': 4, 'type': 'Caption', 'depth': NULL, 'list': NULL, 'n': NULL, 'text': kind, 'md': kind, 'lang': NULL},
        {'i': 7, 'up': NULL, 'type': 'ThematicBreak', 'depth': NULL, 'list': NULL, 'n': NULL, 'text': '', 'md': '---', 'lang': NULL}
    ]) FROM p WHERE k % 4 = 2
    UNION ALL SELECT k, unnest([
        {'i': 0, 'up': NULL::INT, 'type': 'DefinitionList', 'depth': NULL::INT, 'list': NULL::VARCHAR, 'n': NULL::INT, 'text': '', 'md': '', 'lang': NULL::VARCHAR},
        {'i': 1, 'up': 0, 'type': 'DefinitionTerm', 'depth': NULL, 'list': NULL, 'n': 1, 'text': name, 'md': name, 'lang': NULL},
        {'i': 2, 'up': 0, 'type': 'DefinitionTerm', 'depth': NULL, 'list': NULL, 'n': 1, 'text': brand, 'md': brand, 'lang': NULL},
        {'i': 3, 'up': 0, 'type': 'Definition', 'depth': NULL, 'list': NULL, 'n': 1, 'text': kind, 'md': kind, 'lang': NULL},
        {'i': 4, 'up': NULL, 'type': 'CodeBlock', 'depth': NULL, 'list': NULL, 'n': NULL, 'text': 'SELECT ' || k || chr(10) || 'FROM t',
            'md': '```sql' || chr(10) || 'SELECT ' || k || chr(10) || 'FROM t' || chr(10) || '```', 'lang': 'sql'},
        {'i': 5, 'up': NULL, 'type': 'Heading', 'depth': 2, 'list': NULL, 'n': NULL, 'text': kind, 'md': '## [' || kind || '](https://e.example.com/n/' || k || ')', 'lang': NULL},
        {'i': 6, 'up': NULL, 'type': 'Paragraph', 'depth': NULL, 'list': NULL, 'n': NULL, 'text': brand || ' H2Obad e .', 'md': '**' || brand || '** H<sub>2</sub>Obad *e* .', 'lang': NULL}
    ]) FROM p WHERE k % 4 = 3
)
"""
SQL = {
    "block_tree": _TREE
    + """SELECT k AS page_id, x.i AS block_idx, coalesce(x.up, -1) AS parent_idx, x.type AS node_type, coalesce(x.depth, -1) AS depth, x.list AS list_type, coalesce(x.n, -1) AS number, x.text AS text,
    x.md AS md, x.lang AS language, 'https://e.example.com/d/' || k AS uri, 'text/html' AS mime_type FROM b""",
    "structured_documents": _TREE
    + """SELECT k AS page_id, string_agg(x.text, chr(10) || chr(10) ORDER BY x.i) FILTER (WHERE x.text <> '') AS text,
    string_agg(x.md, chr(10) || chr(10) ORDER BY x.i) FILTER (WHERE x.md <> '') AS markdown FROM b GROUP BY k""",
}
