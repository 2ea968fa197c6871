"""Fill-in-middle transformation by DuckDB inside mapInArrow.

Each slice of a batch is handed to an in-process DuckDB as an Arrow table, and
one SELECT cuts the texts into units, draws the two cuts and the form from a
hash of the id, writes the output and rebuilds the text from it. The answer
leaves as Arrow; no Python code sees a row. A row needs nothing of another one,
so nothing is shuffled and a lost task costs its own rows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

#: A unit is a word with the white space before it, or white space at the end (fixed value).
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Marks of prefix, suffix and middle (fixed values).
PRE, SUF, MID = "<P>", "<S>", "<M>"
#: Percent of documents that are transformed, and of those that get the suffix first.
RATE, SPM = 50, 80
SEED = 42
#: Bytes of text that one SELECT takes, unless a single text is longer.
SLICE = 4 << 20

OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"
_TYPES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


def statement(source: str, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> str:
    """The SELECT over a table (doc_id, text). Rebuilding reads nothing but output and form."""
    draw = lambda k: f"CAST('0x' || substr(h, {8 * k - 7}, 8) AS UBIGINT)"
    return f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u, sha256('{int(seed)}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {source}
), drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, {draw(1)} % (len(u) + 1) AS one, {draw(2)} % (len(u) + 1) AS two,
    CASE WHEN text = '' OR contains(text, '{PRE}') OR contains(text, '{SUF}') OR contains(text, '{MID}') OR {draw(3)} % 100 >= {int(rate)} THEN 'plain' WHEN {draw(4)} % 100 < {int(spm)} THEN 'spm' ELSE 'psm' END AS form FROM units
), parts AS (
  SELECT doc_id, n, form, text, array_to_string(list_slice(u, 1, least(one, two)), '') AS pre, array_to_string(list_slice(u, least(one, two) + 1, greatest(one, two)), '') AS mid, array_to_string(list_slice(u, greatest(one, two) + 1, n), '') AS suf FROM drawn
), written AS (
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PRE}' || pre || '{SUF}' || suf || '{MID}' || mid ELSE '{SUF}' || suf || '{PRE}' || pre || '{MID}' || mid END AS output FROM parts
), cut AS (
  SELECT *, instr(output, CASE form WHEN 'psm' THEN '{SUF}' ELSE '{PRE}' END) AS second, instr(output, '{MID}') AS third FROM written
), found AS (
  SELECT *, substr(output, {len(PRE) + 1}, second - {len(PRE) + 1}) AS first_part, substr(output, second + {len(PRE)}, third - second - {len(PRE)}) AS second_part, substr(output, third + {len(MID)}) AS last_part FROM cut
)
SELECT doc_id, n, form, prefix_chars, middle_chars, output, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN first_part || last_part || second_part ELSE second_part || last_part || first_part END) AS restored_sha256
FROM found"""


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256.

    n counts the text's units, form is plain, psm or spm, and output the text as
    training reads it; restored_sha256 is of the text rebuilt from output and
    form. Null and empty texts, and texts that hold a mark, are plain. A null
    doc_id draws as an empty one. Repeated rows come out once each, alike. An
    empty table gives no rows; other columns are ignored. Texts of any length
    are cut whole.
    """
    sql = statement("part", rate, spm, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "autoload_known_extensions": False, "autoinstall_known_extensions": False}) as con:
            for batch in batches:
                for rows in by_bytes(batch, 1, SLICE):
                    con.register("part", pa.Table.from_batches([rows]))
                    yield from con.sql(sql).to_arrow_table().cast(_TYPES).to_batches()
                    con.unregister("part")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


#: The same digests over a whole table, with the units taken apart by place instead of by slices and the text rebuilt from its parts' lengths.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
x AS (SELECT doc_id, text, regexp_extract_all(text, '{UNIT}') AS u, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || h[k:k + 7] AS BIGINT)) AS r FROM d),
c AS (SELECT doc_id, text, len(u) AS n, list_transform(u, lambda w: length(w)) AS sizes, list_sort([r[1] % (len(u) + 1), r[2] % (len(u) + 1)]) AS cuts,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT doc_id, text, n, form, coalesce(list_sum(sizes[:cuts[1]]), 0)::BIGINT AS a, coalesce(list_sum(sizes[cuts[1] + 1:cuts[2]]), 0)::BIGINT AS m FROM c),
o AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, m) AS mid, substr(text, a + m + 1) AS suf FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256, sha256(text) AS restored_sha256 FROM o
"""
