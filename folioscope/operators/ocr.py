"""Plans of OCR jobs; running them is left to a runner."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.languages import catalogue

#: Confidence above which a page is rotated.
ROTATION = {"low": 2, "normal": 15, "high": 30}


@dataclass(frozen=True)
class OcrOptions:
    languages: tuple[str, ...]
    pdfa: bool = False
    rotate: bool = False
    rotation: str = "normal"
    deskew: bool = False
    redo: bool = False
    sidecar: bool = False

    def codes(self) -> str:
        known = catalogue()
        unknown = [x for x in self.languages if x not in known]
        if unknown:
            raise ValueError(f"unknown languages: {', '.join(unknown)}")
        return "+".join(known[x] for x in self.languages)

    def validate(self, in_dir: str, out_dir: str) -> None:
        if not in_dir or not out_dir:
            raise ValueError("input and output folders are needed")
        if in_dir.rstrip("/") == out_dir.rstrip("/"):
            raise ValueError("input and output folders must differ")
        if not self.languages:
            raise ValueError("at least one language is needed")
        if self.deskew and self.redo:
            raise ValueError("deskewing and redoing exclude each other")
        if self.rotation not in ROTATION:
            raise ValueError("rotation is low, normal or high")
        self.codes()

    def record(self) -> Column:
        threshold = F.lit(ROTATION[self.rotation] if self.rotate else None).cast("int")
        return F.struct(F.lit(self.codes()).alias("language"), F.lit("pdfa" if self.pdfa else "pdf").alias("output_type"), F.lit(self.rotate).alias("rotate_pages"), threshold.alias("rotate_pages_threshold"), F.lit(self.deskew).alias("deskew"), F.lit(self.redo).alias("redo_ocr"), F.lit(not self.redo).alias("skip_text"), F.lit(True).alias("invalidate_digital_signatures"))


def plan(paths: DataFrame, in_dir: str, out_dir: str, options: OcrOptions, suffix: str = ".pdf") -> DataFrame:
    """in_path, rel_path, out_path, sidecar_path (null without sidecars) and options for each file with the suffix below in_dir."""
    options.validate(in_dir, out_dir)
    root, target = in_dir.rstrip("/") + "/", out_dir.rstrip("/")
    rows = paths.where(F.endswith("path", F.lit(suffix)) & F.startswith("path", F.lit(root)))
    rel = F.substring("path", F.lit(len(root) + 1), F.length("path"))
    out = F.concat(F.lit(target + "/"), rel)
    side = F.concat(F.regexp_replace(out, "\\.[^./]*$", ""), F.lit(".txt"))
    return rows.select(F.col("path").alias("in_path"), rel.alias("rel_path"), out.alias("out_path"), (side if options.sidecar else F.lit(None).cast("string")).alias("sidecar_path"), options.record().alias("options"))


def folders(jobs: DataFrame) -> DataFrame:
    """Folders that the outputs need, without what they would hold."""
    return jobs.select(F.regexp_replace("out_path", "/[^/]*$", "").alias("folder")).distinct()


class OcrUnavailable(RuntimeError):
    """No OCR engine is installed."""


def no_engine(job: Row) -> None:
    raise OcrUnavailable("no OCR engine is installed; pass a runner of your own")


def run(jobs: DataFrame, runner: Callable[[Row], None] = no_engine) -> DataFrame:
    """Run every job on the executors; in_path, ok and error of each. A job that fails is reported, and the others go on."""
    import pandas as pd

    def each(batches):
        for batch in batches:
            said = []
            for job in batch.to_dict("records"):
                try:
                    runner(Row(**job))
                    said.append((job["in_path"], True, None))
                except OcrUnavailable:
                    raise
                except Exception as e:
                    said.append((job["in_path"], False, str(e)))
            yield pd.DataFrame(said, columns=["in_path", "ok", "error"])

    return jobs.mapInPandas(each, "in_path string, ok boolean, error string")
