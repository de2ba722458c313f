"""Structured file names: parse, build, match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.config import TEMPLATE_SPACE


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parse_entities(df: DataFrame, path: str = "path", datatype: str = "anat") -> DataFrame:
    """Split ``dataset/…/anat/k-v_k-v_suffix.ext`` into dataset, suffix and an entity map.

    The name is cut at its first dot.  Items without a dash are ignored; of a repeated key the
    last value counts.  ``reject_reason`` is NULL for a valid name, and names the first rule a bad
    one breaks.
    """
    parts = F.split(F.col(path), "/")
    found = F.get(parts, F.size(parts) - 2)
    name_parts = F.split(base_name(F.col(path)), "[.]", 2)
    stem = F.get(name_parts, F.lit(0))
    items = F.filter(
        F.split(F.regexp_replace(stem, "_[^_]*$", ""), "_"), lambda x: x.contains("-")
    )
    keys = F.array_distinct(F.transform(items, lambda x: F.substring_index(x, "-", 1)))
    values = F.transform(
        keys,
        lambda k: F.substring_index(
            F.try_element_at(
                F.filter(items, lambda x: F.substring_index(x, "-", 1) == k), F.lit(-1)
            ),
            "-",
            -1,
        ),
    )
    reason = (
        F.when(F.size(parts) < 2, "path without a directory")
        .when(found != datatype, F.concat(F.lit("invalid datatype "), found))
        .when(F.size(name_parts) < 2, "name without an extension")
        .when(~stem.contains("_"), "name without a suffix")
        .when(
            F.exists(items, lambda x: F.size(F.split(x, "-")) > 2), "entity with more than one dash"
        )
    )
    return df.withColumns(
        {
            "dataset": F.get(parts, F.lit(0)),
            "datatype": found,
            "suffix": F.substring_index(stem, "_", -1),
            "entities": F.map_from_arrays(keys, values),
            "reject_reason": reason,
        }
    )


def promote(df: DataFrame, keys: Sequence[str], source: str = "entities") -> DataFrame:
    """Known entity keys as string columns; absent keys give NULL."""
    return df.withColumns({k: F.try_element_at(F.col(source), F.lit(k)) for k in keys})


def capture(df: DataFrame, col: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """One column per numbered group of ``pattern``; all NULL when it does not match."""
    c = F.col(col)
    hit = c.rlike(pattern)
    return df.withColumns(
        {n: F.when(hit, F.regexp_extract(c, pattern, i)) for i, n in enumerate(names, start=1)}
    )


def scan_identifier(participant: Column, wave: Column, scan: Column) -> Column:
    return F.concat(participant, F.lit("_ses-"), wave, F.lit("_"), scan, F.lit("_T1w"))


def image_stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.nii\.gz$", "")


def swap_suffix(c: Column, old: str, new: str) -> Column:
    """Name of a sibling file."""
    return F.replace(c, F.lit(old), F.lit(new))


def first_token(c: Column) -> Column:
    return F.split_part(c, F.lit("_"), F.lit(1))


def output_layout(root: str, space: str = TEMPLATE_SPACE) -> dict[str, tuple[str, str]]:
    """Directory and name ending of the six outputs; the image stem stands between them."""
    base = f"{root.rstrip('/')}/" if root else ""
    seg = f"{base}derivatives/synthseg/"
    return {
        "processed": (f"{base}processed/", f"_space-{space}_desc-processed.nii.gz"),
        "mask": (f"{base}derivatives/masks/", f"_space-{space}_desc-brain_mask.nii.gz"),
        "xfm": (f"{base}derivatives/transforms/", f"_from-native_to-{space}_mode-image_xfm.mat"),
        "seg": (seg, "_desc-synthseg_dseg.nii.gz"),
        "vol": (seg, "_volumes.csv"),
        "qc": (seg, "_qc.csv"),
    }


def plan_paths(
    df: DataFrame, root: str, path: str = "path", space: str = TEMPLATE_SPACE
) -> DataFrame:
    """The six output paths that belong to an input image."""
    stem = image_stem(F.col(path))
    return df.withColumns(
        {
            name: F.concat(F.lit(folder), stem, F.lit(ending))
            for name, (folder, ending) in output_layout(root, space).items()
        }
    )


def glob_to_regex(pattern: str) -> str:
    """``*`` and ``?`` wildcards as an anchored regular expression; ``*`` also spans ``/``."""
    quoted = {"*": ".*", "?": "."}
    return "(?s)^" + "".join(quoted.get(ch, ch if ch.isalnum() else "\\" + ch) for ch in pattern) + "$"


def path_rules(c: Column, rules: Sequence[tuple[str, str]], default: bool = True) -> Column:
    """Ordered include/exclude rules; the last matching rule decides."""
    keep = F.lit(default)
    for action, pattern in rules:
        keep = F.when(c.rlike(glob_to_regex(pattern)), F.lit(action == "include")).otherwise(keep)
    return keep
