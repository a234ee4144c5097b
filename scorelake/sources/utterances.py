"""The utterances of a matrix, read part by part.

Planning which rows are missing needs keys only; transcribing them needs audio,
which is large. So a source has two sides: ``keys`` reads no column of the rows
but their place, and ``rows`` reads audio and reference of the wanted parts. A
part is a file where rows come from files, so no file is opened for a unit of
work that does not need it, and each is read once per run.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.sources.catalog import DATASETS, DatasetSpec, parse_dataset_spec
from scorelake.sources.tables import file_hash, file_offsets

# Rows of a part, where rows do not come from files of their own.
ROWS_PER_PART = 100_000


def spec_of(dataset: str, audio_col: str, reference_col: str) -> DatasetSpec:
    """The catalog's spec; a dataset that the catalog lacks is named as it is."""
    name, _, split = dataset.partition(":")
    if name.strip() in {row[0] for row in DATASETS}:
        return parse_dataset_spec(dataset)
    return DatasetSpec(name, None, None, audio_col, reference_col, split)


@dataclass
class FileUtterances:
    """Datasets that are file scans: ``scans[dataset]`` comes straight from a
    reader, and ``specs[dataset]`` (default: the catalog's) names its columns."""

    scans: Mapping[str, DataFrame]
    specs: Mapping[str, DatasetSpec]
    _placed: dict[tuple, DataFrame] = field(default_factory=dict, repr=False)

    def spec(self, dataset: str) -> DatasetSpec:
        return self.specs[dataset] if dataset in self.specs else parse_dataset_spec(dataset)

    def keys(self, datasets: set[str]) -> DataFrame | None:
        """``(dataset, part, row_index)`` of every row; reads no column."""
        out = None
        for name in sorted(datasets & set(self.scans)):
            one = self._with_place(name).select(F.lit(name).alias("dataset"), "part", "row_index")
            out = one if out is None else out.unionByName(one)
        return out

    def rows(self, dataset: str, parts: list[int]) -> DataFrame:
        """``(part, row_index, _audio, _reference)`` of some parts. The condition is
        one on the files' names, so Spark opens no others."""
        spec = self.spec(dataset)
        return self._with_place(dataset, (spec.audio_column, "_audio"), (spec.reference_column, "_reference")).where(F.col("part").isin(parts))

    def _with_place(self, name: str, *columns: tuple[str, str]) -> DataFrame:
        if (name, columns) not in self._placed:
            scan = self.scans[name]
            own = scan.select(*[F.col(c).alias(as_) for c, as_ in columns], file_hash(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row"))
            self._placed[name, columns] = own.join(file_offsets(scan), "_file").select(F.col("_file").alias("part"), (F.col("_offset") + F.col("_row")).alias("row_index"), *[as_ for _, as_ in columns])
        return self._placed[name, columns]


@dataclass
class TableUtterances:
    """Any table ``(dataset, row_index, <audio>, <reference>)``; a part is a range of row indexes."""

    table: DataFrame
    audio_col: str = "audio"
    reference_col: str = "transcription"
    rows_per_part: int = ROWS_PER_PART

    def spec(self, dataset: str) -> DatasetSpec:
        return spec_of(dataset, self.audio_col, self.reference_col)

    def _part(self):
        return F.expr(f"row_index div {self.rows_per_part}")

    def keys(self, datasets: set[str]) -> DataFrame | None:
        return self.table.where(F.col("dataset").isin(sorted(datasets))).select("dataset", self._part().alias("part"), "row_index")

    def rows(self, dataset: str, parts: list[int]) -> DataFrame:
        wanted = (F.col("dataset") == dataset) & self._part().isin(parts)
        return self.table.where(wanted).select(self._part().alias("part"), "row_index", F.col(self.audio_col).alias("_audio"), F.col(self.reference_col).alias("_reference"))
