"""Names to readers and options: data sets, loaders, featurizers, upsamplers, configurations and run names."""

from __future__ import annotations

import dataclasses
import os
import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import grids, loaders
from gridloom.sources import scans

#: Names of backbones, their patch size and width; aliases after the first name.
FEATURIZERS = (
    (("dinov2",), 14, 384), (("dinov2b",), 14, 768), (("dinov2s_reg",), 14, 384), (("dinov2b_reg",), 14, 768),
    (("dinov3splus", "dinov3_splus", "dinov3-vits16plus"), 16, 384), (("dinov3base", "dinov3b", "dinov3_base", "dinov3-vitb16"), 16, 768),
    (("clip",), 16, 512), (("siglip",), 16, 768), (("siglip2",), 16, 768),
)


def featurizers(spark: SparkSession) -> DataFrame:
    """(name, canonical, patch_size, dim) of every name and alias: a lookup table of a few rows."""
    rows = [(name, names[0], patch, dim) for names, patch, dim in FEATURIZERS for name in names]
    return spark.createDataFrame(rows, "name string, canonical string, patch_size int, dim int")


def featurizer(name: str) -> tuple[str, int, int]:
    """(canonical name, patch size, width); an unknown name is an error."""
    for names, patch, dim in FEATURIZERS:
        if name.lower() in names:
            return names[0], patch, dim
    raise ValueError(f"{name!r} names no backbone; there are {', '.join(n for names, *_ in FEATURIZERS for n in names)}")


def kernel_size(model: Column) -> Column:
    """14 for names that contain dinov2, else 16."""
    return F.when(F.contains(F.lower(model), F.lit("dinov2")), 14).otherwise(16)


#: Functions of (grid, height, width, new height, new width). The learned upsampler is a neural model, which is out of scope.
UPSAMPLERS: dict[str, Callable[..., DataFrame]] = {"bilinear": grids.resize_bilinear, "bicubic": grids.resize_bicubic, "nearest": grids.resize_nearest}


def upsampler(name: str) -> Callable[..., DataFrame]:
    """The resampling of a name; an unknown name is an error."""
    if name not in UPSAMPLERS:
        raise ValueError(f"{name!r} names no upsampler; there are {', '.join(UPSAMPLERS)}")
    return UPSAMPLERS[name]


def dataset(spark: SparkSession, name: str, root: str, split: str, **options) -> DataFrame:
    """The scan of a data set by name; an unknown name is an error."""
    if name == "cocostuff":
        return scans.list_scan(spark, f"{root}/cocostuff", split, options.get("list_file", "Coco164kFull_Stuff_Coarse.txt"))
    if name == "cityscapes":
        return scans.city_scan(spark, f"{root}/cityscapes", split)
    if name == "sa1b":
        return scans.split_pairs(scans.paired(scans.files(spark, root)), split, **options)
    raise ValueError(f"{name!r} names no data set; there are cityscapes, cocostuff and sa1b")


def make_loaders(samples: DataFrame, options: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """(train, val) streams of samples (shard, place, key, ...): finite intervals where ``train_samples`` is set, else cycling splits.

    Validation has batches of one and no json, which Catalyst then does not read.
    """
    if "world_size" not in options or not options.get("shards"):
        raise ValueError("the options need shards and world_size")
    light = samples.drop("json")
    workers, world = options.get("workers", 1), options["world_size"]
    if options.get("train_samples") is not None:
        n, val = options["train_samples"], options["val_samples"]
        finite = lambda rows, start, count, batch: loaders.finite_stream(rows, options["samples_per_shard"], start, count, batch, world, workers)
        return finite(samples, 0, n, options.get("batch_size", 2)), finite(light, n, val, 1)
    cycling = lambda rows, split, batches, batch: loaders.cycling_stream(rows, options["shards"], split, batches, batch, world, workers, options.get("val_fraction", 0.05), options.get("seed", 42))
    return cycling(samples, "train", options.get("train_batches", 1000), options.get("batch_size", 2)), cycling(light, "val", options.get("val_batches", 100), 1)


def composed(defaults: list[Mapping[str, Any]], own: Mapping[str, Any], environment: Mapping[str, str] | None = None, arguments: list[str] | None = None) -> dict:
    """A configuration from defaults in order, own values, and key=value arguments; ``${name}`` and ``${env:NAME,default}`` are filled in."""
    out: dict = {}
    for part in (*defaults, own):
        out |= part
    for argument in arguments or []:
        name, sign, value = argument.partition("=")
        if not sign or name not in out:
            raise ValueError(f"unknown setting {argument}")
        out[name] = type(out[name])(value) if out[name] is not None and not isinstance(out[name], bool) else value in ("true", "True", "1") if isinstance(out[name], bool) else value
    env = os.environ if environment is None else environment

    def filled(value, depth: int = 0):
        if not isinstance(value, str) or depth > 20:
            return value
        whole = re.fullmatch(r"\$\{([A-Za-z_.]+)\}", value)
        if whole and whole[1] in out:
            return filled(out[whole[1]], depth + 1)

        def one(m):
            if m[1].startswith("env:"):
                name, _, default = m[1][4:].partition(",")
                return env.get(name, default)
            return str(filled(out[m[1]], depth + 1))

        return re.sub(r"\$\{([^}]+)\}", one, value)

    return {k: filled(v) for k, v in out.items()}


def experiment_name(first: bool = True) -> Column:
    """The name of an experiment from the columns of its settings, first or second stage."""
    if first:
        form = "%s_%s_depth%d_loadsize_%d_upsample_size_%d_%s_%s_tv_%s_sam_alpha_%s_sam_reg_%s_RGB_%s_clamp_%s"
        names = ("model_type", "upsampler_type", "upsampler_num_layers", "load_size", "upsample_size", "dataset", "downsampler_type", "tv_weight", "sam_mask_alpha", "sam_mask_reg", "color_feats", "clamp_featup")
    else:
        form = "HR_%d_LR_%d_FeatUp%s_%s_%s_n_freqs_%d_sam_reg_%s_sam_hr_alpha_%s_sam_hr_reg_%s_%s_crf_0.0_tv_%s_rec_%s_n_jitters_%d_ddp_stopgrad"
        names = ("hr_res", "lr", "use_featup", "model_type", "upsampler_type", "n_freqs", "sam_mask_reg", "sam_mask_hr_alpha", "sam_mask_hr_reg", "dataset", "tv_weight", "rec_weight", "n_jitters")
    return F.format_string(form, *names)


def run_id(at: Column | None = None, unique: Column | None = None) -> Column:
    """A UTC time and eight hex digits, as 20240131T235959Z-0123abcd; the session's time zone must be UTC."""
    unique = F.expr("uuid()") if unique is None else unique
    return F.concat(F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(F.replace(unique, F.lit("-"), F.lit("")), 1, 8))


@dataclasses.dataclass(frozen=True)
class Hooks:
    """A caller's changes to each record: functions of Columns, so that they stay in the plan."""

    image: Callable[[Column], Column] | None = None
    target: Callable[[Column], Column] | None = None

    def apply(self, rows: DataFrame, image: str, target: str) -> DataFrame:
        """The rows with both functions applied; None leaves a column as it is."""
        changes = {c: f(F.col(c)) for c, f in ((image, self.image), (target, self.target)) if f is not None}
        return rows.withColumns(changes) if changes else rows
