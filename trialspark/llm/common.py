"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns under fixed names, so other columns cannot clash: ``columns(df, id="doc_id")``."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in wanted.items()])


def map_rows(df: DataFrame, schema: str, work: Callable[[], Callable[[pa.RecordBatch], Iterable[dict[str, list]]]]) -> DataFrame:
    """Arrow batches through ``work()``, which is called once a task; it turns a batch into column dicts."""
    spark_schema = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(spark_schema)
        step = None
        for batch in batches:
            step = step or work()
            for out in step(batch):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def same_schema_as(df: DataFrame, template: DataFrame) -> DataFrame:
    """The template's columns, in its order and types."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in template.schema.fields])
