"""Fill-in-middle transformation by DuckDB SQL over Arrow batches.

Every batch that Spark hands to a task is registered with a DuckDB connection
of that task, transformed by one SQL statement and returned as Arrow; no
Python touches a row.  A text is cut into tokens (runs of Latin letters, any
other code point alone), two cut places and the form are drawn from a hash of
the document's id, and the parts are put together around three marks:

* plain: the text itself (empty texts, texts that hold a mark, and a tenth of the others);
* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle (a fifth of those that are not plain).

The marks overlap neither themselves nor one another and no transformed text
holds one, so the text is rebuilt from output and form alone.

No shuffle.  A task holds one slice of a batch: some SLICE code points, or one
longer text, for which the list of tokens takes up to 60 bytes a code point.
Null text is the empty text (plain); a null id is hashed as the word ``null``;
rows with one id are cut by the same draws, equal rows give equal outputs; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from oreflow.llm import common

#: Code points of a slice, but for longer single texts.
SLICE = 1 << 20
PLAIN_FROM, SPM_BELOW = 90, 20

#: Batch -> doc_id, n, form, the parts' sizes and the output.
SPLIT = rf"""
    SELECT doc_id, n, form,
        CASE WHEN form != 'plain' THEN length(prefix) END AS prefix_chars,
        CASE WHEN form != 'plain' THEN length(middle) END AS middle_chars,
        CASE form WHEN 'plain' THEN text
            WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
    FROM (
        SELECT doc_id, text, n, form,
            array_to_string(list_slice(tokens, 1, least(a, b)), '') AS prefix,
            array_to_string(list_slice(tokens, least(a, b) + 1, greatest(a, b)), '') AS middle,
            array_to_string(list_slice(tokens, greatest(a, b) + 1, n), '') AS suffix
        FROM (
            SELECT doc_id, text, tokens, len(tokens) AS n,
                h1 % (len(tokens) + 1) AS a, h2 % (len(tokens) + 1) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {PLAIN_FROM}
                    THEN 'plain' WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form
            FROM (
                SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens,
                    CAST('0x' || digest[1:8] AS BIGINT) AS h1, CAST('0x' || digest[9:16] AS BIGINT) AS h2,
                    CAST('0x' || digest[17:24] AS BIGINT) AS h3, CAST('0x' || digest[25:32] AS BIGINT) AS h4
                FROM (SELECT doc_id, text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest FROM batch)
            )
        )
    )"""

#: form, output -> the text.
REBUILT = """
    CASE form WHEN 'plain' THEN output
        WHEN 'psm' THEN
            substring(output, 4, instr(output, '<S>') - 4) || substring(output, instr(output, '<M>') + 3)
            || substring(output, instr(output, '<S>') + 3, instr(output, '<M>') - instr(output, '<S>') - 3)
        ELSE
            substring(output, instr(output, '<P>') + 3, instr(output, '<M>') - instr(output, '<P>') - 3) || substring(output, instr(output, '<M>') + 3)
            || substring(output, 4, instr(output, '<P>') - 4)
    END"""

RESTORE = f"SELECT doc_id, {REBUILT} AS text FROM batch"
DIGESTS = f"""
    SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256({REBUILT}) AS restored_sha256
    FROM ({SPLIT})"""


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SLICE code points of its column ``text``."""
    ends = np.cumsum(pc.utf8_length(batch.column(text)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _by_sql(df: DataFrame, sql: str, text: int, schema: str) -> DataFrame:
    """``mapInArrow`` by a statement over the table ``batch``."""
    arrow = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        con.execute("SET preserve_insertion_order = true")
        for whole in batches:
            for part in _slices(whole, text):
                con.register("batch", pa.Table.from_batches([part]))
                found = con.sql(sql).to_arrow_table().cast(arrow)
                con.unregister("batch")
                yield from found.to_batches()
        con.close()
        common.release()

    return df.mapInArrow(run, schema)


RESULT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint"


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document."""
    return _by_sql(common.texts(docs, id_col, text_col), SPLIT, 1, RESULT + ", output string")


def restored(rows: DataFrame) -> DataFrame:
    """``doc_id, text`` rebuilt from the columns form and output of :func:`transformed`."""
    return _by_sql(rows.select("doc_id", "form", "output"), RESTORE, 2, "doc_id bigint, text string")


def digests(docs: DataFrame) -> DataFrame:
    """The sizes of :func:`transformed` with the digests of its output and of the text rebuilt from it; no text leaves the task."""
    return _by_sql(common.texts(docs), DIGESTS, 1, RESULT + ", output_sha256 string, restored_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.dealt(common.table(spark, sf_dir, "documents")))


#: The same by code points: the places of the cuts are sums of the tokens' lengths, and the rebuilt text is the text.
ORACLE_SQL = """
WITH base AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS d,
        list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]'), lambda x: length(x)) AS sizes
    FROM documents
), cut AS (
    SELECT doc_id, text, sizes, len(sizes) AS n,
        ('0x' || d[1:8])::BIGINT % (len(sizes) + 1) AS a, ('0x' || d[9:16])::BIGINT % (len(sizes) + 1) AS b,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || d[17:24])::BIGINT % 100 >= 90 THEN 'plain'
            WHEN ('0x' || d[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM base
), placed AS (
    SELECT doc_id, text, n, form, coalesce(list_sum(sizes[1:least(a, b)]), 0)::BIGINT AS p, coalesce(list_sum(sizes[1:greatest(a, b)]), 0)::BIGINT AS q
    FROM cut
)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN p END AS prefix_chars, CASE WHEN form != 'plain' THEN q - p END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN concat('<P>', substring(text, 1, p), '<S>', substring(text, q + 1), '<M>', substring(text, p + 1, q - p))
        ELSE concat('<S>', substring(text, q + 1), '<P>', substring(text, 1, p), '<M>', substring(text, p + 1, q - p)) END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM placed
"""
