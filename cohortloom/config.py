"""Default thresholds and fixed lookup values."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: they must equal the published curation rules -----------------------------

KEEP_SUFFIXES = ("T1w", "T2w", "FLAIR")

SEX_SPELLINGS = {
    "m": "M",
    "male": "M",
    "man": "M",
    "f": "F",
    "female": "F",
    "woman": "F",
}

# dataset id -> exact header of its age column
AGE_COLUMN_BY_DATASET = {
    "ds000144": "ScanAge",
    "ds001486": "age_ses-T1",
    "ds001894": "age_ses-T1_T1w",
    "ds002424": "age_ses-T1",
    "ds002886": "age_ses-T1",
    "ds003425": "Age_Sess1",
    "ds003710": "age_ses-1",
    "ds005027": "ScanAge",
}

# dataset id -> unit of its age column
AGE_UNIT_BY_DATASET = {"ds006169": "months"}

LONGITUDINAL_DATASET = "ds004856"

# wave -> header of the age column for that wave
WAVE_AGE_COLUMNS = {"wave1": "AgeMRI_W1", "wave2": "AgeMRI_W2", "wave3": "AgeMRI_W3"}

# spellings of a missing value in delimited text
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# file-name patterns: participant, wave (and scan)
SCAN_NAME_PATTERN = r"^(sub-[^_]+)_ses-(wave[123])_"
VOLUME_NAME_PATTERN = (
    r"^(sub-[^_]+)_ses-(wave[123])_(.+?)_space-[^_]+_desc-preproc_T1w_desc-synthseg_volumes\.tsv$"
)
VOLUME_FILE_SUFFIX = "_volumes.tsv"
QC_FILE_SUFFIX = "_qc.tsv"

# why an image gets no label: name, participant, age column
SKIP_REASONS = (
    "filename did not match DLBS pattern",
    "%s not in participants.tsv",
    "%s missing",
)

REFERENCE_REGION = "total intracranial"
TEMPLATE_SPACE = "MNI152NLin2009cAsym"
OUTPUT_DIRECTORIES = ("processed", "derivatives", "logs")

QC_THRESHOLD = 0.65
LARGE_AGE = 85
MIN_LABELLED_SUBJECTS = 50

RIDGE_FOLDS = 5
RIDGE_ALPHAS = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0, 10000.0)

# path rules, applied in order, the last match wins: (action, pattern)
DOWNLOAD_RULES = (
    ("exclude", "*"),
    ("include", "*_T1w.*"),
    ("include", "*_T2w.*"),
    ("include", "*_FLAIR.*"),
    ("include", "*participants.*"),
    ("exclude", "*bidsignore*"),
    ("exclude", "*derivatives*"),
    ("exclude", "*desc-preproc*"),
)

# --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class InclusionLimits:
    """Bounds of the image inclusion mask; all of them are inclusive."""

    ndim: int = 3
    size_mb_low: float = 1.0
    size_mb_high: float = 60.0
    voxel_low: float = 0.3
    inplane_high: float = 1.5
    slice_high: float = 3.0
    fov_low: float = 120.0
    fov_high: float = 260.0


@dataclass(frozen=True)
class OutlierLimits:
    """Bounds of the data-quality report, in bytes."""

    small_bytes: int = 100_000
    big_bytes: int = 100_000_000
