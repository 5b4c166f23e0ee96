"""Row types of the engine: one flat DataFrame per kind of thing, with the reading order in ``seq``."""

from __future__ import annotations

from pyspark.sql.types import StructType

BLOCKS = (
    "artifact_id string, seq int, block_id string, block_type string, text string, page int, slide int, sheet string, cell_range string,"
    " line_index int, paragraph_index int, table_index int, shape_index int, level int, list_level int, image_count int,"
    " grid array<array<string>>, n_rows int, n_cols int, merged array<string>, rows_truncated boolean, columns_truncated boolean, cells_truncated boolean,"
    " header_row int, extraction_method string, confidence double, continues_from_previous boolean, continued_on_next boolean, continuation_id string"
)


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
