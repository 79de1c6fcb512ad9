"""An experiment end to end, as one lazy plan: files -> frames -> wells -> cells -> tables."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field, fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsegrid.functions.pixels import inverse_mixing
from lapsegrid.operators import segment, stack, tables, tracking, wells
from lapsegrid.sources import manifest, tiff


@dataclass(frozen=True)
class Config:
    """What the run needs to know. Roles are channel names; tokens pick their files."""

    tokens: dict[str, str]
    patterns: list[np.ndarray]
    wells_per_row: int = 8
    well_size: int = 233
    half_window: int = 115
    margin: int = 70
    bright: str = "bright"
    effector: str = "effector"
    target: str = "target"
    death: str = "death"
    mixing: tuple[float, float, float, float] | None = None
    sigma: float = 40.0
    well_sigma: float = 30.0
    settings: segment.Settings = field(default_factory=segment.Settings)
    count_frames: int = 7
    least_split: int = 50
    gate: float = 0.0
    """Cells whose centres are further apart are no candidates for a link; 0: all pairs of two frames are."""
    exact: bool = False

    def __post_init__(self):
        shapes = {p.shape for p in self.patterns}
        if len(shapes) != 1 or any(n % 2 == 0 for n in next(iter(shapes))):
            raise ValueError("patterns must share one odd shape")
        if self.bright not in self.tokens or self.wells_per_row < 1:
            raise ValueError("a bright-field channel and a grid are needed")


WELL = ["block", "row", "col"]


def _shown(value) -> str:
    """A setting as text that tells different ones apart."""
    if isinstance(value, np.ndarray):
        return f"{value.shape} {value.dtype} {hashlib.sha256(np.ascontiguousarray(value).tobytes()).hexdigest()}"
    return repr([_shown(v) for v in value]) if isinstance(value, list) else repr(value)


class Experiment:
    """The stages of a run. Each is a DataFrame; nothing runs until one is asked for. Stages
    that several others read can be given a table (``persist_to``) at a cut; a run that is started again
    reads the tables that are there. ``reused`` names them."""

    def __init__(self, spark: SparkSession, folder: str, config: Config, persist_to: str | None = None):
        shared = spark.conf.get("spark.checkpoint.dir", None)
        self.spark, self.folder, self.c = spark, folder, config
        self.resumes, self.reused, self.mark = persist_to is not None, [], None
        self.to = persist_to or (f"{shared.rstrip('/')}/experiment-{uuid.uuid4().hex}" if shared else None)

    def fingerprint(self) -> str:
        """What a stage's rows depend on: the settings, and the names, sizes and times of the input files."""
        if self.mark is None:
            files = manifest.list_files(self.spark, self.folder)
            n, total = files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
            own = repr([(f.name, _shown(getattr(self.c, f.name))) for f in fields(self.c)])
            self.mark = hashlib.sha256(f"{own} {n} {total}".encode()).hexdigest()[:16]
        return self.mark

    def kept(self, frame: DataFrame, name: str) -> DataFrame:
        """Cut the lineage at a shared table, if there is a place for one: ``persist_to``, or else a
        folder of this run where spark.checkpoint.dir says. In ``persist_to`` a table of the same settings and input files that
        was written to its end - Spark's mark of that comes last - is read and not made again; one that a run left unfinished is
        written anew, and tables of other settings stay beside it."""
        if not self.to:
            return frame
        path = f"{self.to}/{name}" + (f"-{self.fingerprint()}" if self.resumes else "")
        if self.resumes and manifest.exists(self.spark, f"{path}/_SUCCESS"):
            self.reused.append(name)
            return self.spark.read.schema(frame.schema).parquet(path)
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def frames(self) -> DataFrame:
        """Manifest and pixels: (block, channel, frame, width, height, px), borders repaired. Names are parsed
        before contents are read, and the parsed keys travel with their own file: files are never joined by name."""
        channels = self.spark.createDataFrame(list(self.c.tokens.items()), "role string, token string")
        found = manifest.zeiss(tiff.files_of(self.spark, self.folder), channels).withColumnRenamed("role", "channel")
        rows = tiff.decode_frames(found, ["block", "channel", "frame"], first=1).drop("page")
        return stack.repair_borders(self.kept(rows, "decoded"))

    def clean_frames(self, frames: DataFrame) -> DataFrame:
        """Unmixed, then background-subtracted fluorescence channels; bright field as it is."""
        if self.c.mixing:
            frames = stack.unmix_frames(frames, self.c.target, self.c.effector, inverse_mixing(*self.c.mixing))
        dark = frames.where(F.col("channel") != self.c.bright)
        return frames.where(F.col("channel") == self.c.bright).unionByName(stack.subtract_background(dark, self.c.sigma))

    def run(self) -> dict[str, DataFrame]:
        """wells, shifts, crops, seeds, counts, cells, links, features, table and compositions."""
        c = self.c
        clean = self.kept(self.clean_frames(self.frames()), "frames")
        bright = clean.where(F.col("channel") == c.bright)
        found = self.kept(stack.register_wells(bright, c.patterns, c.wells_per_row, c.well_size, c.margin, c.exact, c.well_sigma), "wells")
        path = self.kept(stack.shifts(bright), "shifts")
        cells_in = clean.where(F.col("channel").isin(c.effector, c.target))
        marked = self.kept(segment.segment_frames(cells_in, [*stack.STACK, "frame"], stack.KINDS, c.settings), "masks")
        sized = marked.join(cells_in.select(*stack.STACK, "frame", "width"), [*stack.STACK, "frame"])
        masks = stack.crop_wells(sized.select(*stack.STACK, "frame", "width", F.transform("mask", lambda v: v.cast("int")).alias("px")), found, path, c.well_size)
        crops = self.kept(stack.crop_wells(clean.where(F.col("channel") != c.bright), found, path, c.well_size), "crops")

        seeds = marked.select(*stack.STACK, "frame", F.explode("seeds").alias("s")).select(*stack.STACK, "frame", "s.x", "s.y")
        spots = found.select("block", "row", "col", F.col("x").alias("x0"), F.col("y").alias("y0")).join(path, "block")
        windows = spots.select("block", "frame", "row", "col", (F.col("x0") - F.col("px")).alias("cx"), (F.col("y0") - F.col("py")).alias("cy"))
        pairs = wells.seeds_in_windows(seeds, windows, ["block", "frame"], c.half_window)
        spine = windows.withColumn("channel", F.explode(F.array(F.lit(c.effector), F.lit(c.target)))).select(*WELL, "channel", "frame")
        counts = self.kept(wells.seed_counts(pairs, spine, [*WELL, "channel", "frame"]), "counts")
        numbers = wells.cell_number(counts, [*WELL, "channel"], c.count_frames)

        cells = self.kept(stack.split_cells(masks, numbers, c.least_split), "cells")
        group = [*WELL, "channel"]
        steps = tracking.next_frames(cells, group).where("next_frame is not null")
        flat = cells.drop("pts")
        candidates = tracking.gated_candidates(flat, group, c.gate) if c.gate else tracking.link_candidates(flat, group)
        terms = stack.pair_overlaps(cells, steps, group)
        cost = tracking.with_overlap_cost(tracking.with_cost(candidates.join(terms, [*group, "frame", "next_frame", "cell", "cell2"])))
        weighed = tracking.with_weight(cost, group)
        links = self.kept(tracking.assignments(weighed, group).join(steps, [*group, "frame"]), "links")
        tracks = tracking.chains(cells, links, group)
        return {
            "wells": found, "shifts": path, "crops": crops, "seeds": seeds, "counts": counts, "cells": cells, "links": links,
            **self.tables(cells.join(tracks, [*group, "frame", "cell"]), crops),
        }

    def tables(self, cells: DataFrame, crops: DataFrame) -> dict[str, DataFrame]:
        """Per-cell features, pixel means, compositions and the 49-row well blocks."""
        c = self.c
        group = [*WELL, "channel", "track"]
        vx, vy, vxy = (F.expr(f"aggregate(pts, 0D, (a, p) -> a + {t}) / size(pts)") for t in ("(p.x - x) * (p.x - x)", "(p.y - y) * (p.y - y)", "(p.x - x) * (p.y - y)"))
        q = F.sqrt((vx - vy) * (vx - vy) + 4 * vxy * vxy)
        base = cells.withColumn("ratio", F.round(F.sqrt(F.greatest(F.lit(0.0), vx + vy + 1 / 6 - q) / (vx + vy + 1 / 6 + q)), 6))
        base = tracking.displacement(base, group, "frame")
        base = stack.intensity_features(base, crops.where(F.col("channel") == c.death), "death")
        near = stack.association_features(base.where(F.col("channel") == c.target), crops.where(F.col("channel") == c.effector)).drop("pts")
        features = base.drop("pts").join(near.select(*group, "frame", "assoc"), [*group, "frame"], "left")
        pixel = crops.select(*WELL, "channel", "frame", F.round(stack.px_sum() / F.size("px"), 6).alias("mean"))
        many = features.groupBy(*WELL, "channel").agg(F.countDistinct("track").alias("k"))
        well = F.struct(*WELL)
        count = lambda role: many.where(F.col("channel") == role).select(well.alias("well"), "k")
        kept = wells.composition(count(c.effector), count(c.target), "well").select("well.*", "effectors", "targets", "composition", "routed")
        values = F.expr("stack(6, 'x', x, 'y', y, 'ratio', ratio, 'displacement', displacement, 'death', death, 'assoc', assoc) as (name, value)")
        part = F.when(F.col("channel") == c.effector, "effector").otherwise("target")
        long = features.join(kept.select(*WELL), WELL, "left_semi").select(*WELL, part.alias("part"), (F.col("track") - 1).cast("int").alias("target"), "frame", values)
        return {"features": features, "pixel_means": pixel, "compositions": kept, "long": long.where("value is not null")}

    def well_blocks(self, found: dict[str, DataFrame], frames: list[int]) -> DataFrame:
        return tables.well_block(found["long"], WELL, frames)
