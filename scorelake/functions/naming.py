"""What a metric's name says: category, direction and plausible range, as ordered rules.

Each function builds one CASE over a name column, so a dimension table of names is all it touches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.functions.columns import contains_any

_SQUIM, _SEPM = "torch_squim_", "pysepm_"
_ERRORS = ("delete", "insert", "replace", "equal")
#: Exact names first.
EXACT: dict[str, tuple[str, ...]] = {
    "audio_quality": (*(f"dns_{k}" for k in ("overall", "p808")), *(f"dnsmos_pro_{k}" for k in ("bvcc", "nisqa", "vcc2018")), "nisqa", "noresqa", "plcmos", "scoreq_nr", "scoreq_ref", "sheet_ssqa", "singmos", _SQUIM + "mos", "utmos", "utmosv2", "warpq"),
    "speech_enhancement": (*(_SQUIM + k for k in ("pesq", "si_sdr", "stoi")), *(f"se_{k}" for k in ("ci_sdr", "sar", "sdr", "si_snr")), "ci-sdr", "pesq", "sar", "sdr", "si-snr", "sir", "stoi", "visqol"),
    "psychoacoustic": (*(_SEPM + k for k in ("c_bak", "c_ovl", "c_sig", "cd", "csii_high", "csii_low", "csii_mid", "fwsegsnr", "llr", "ncm", "wss")), "pam", "srmr"),
    "asr_wer_cer": (*(f"{m}_{k}{e}" for m in ("espnet", "owsm") for k in ("cer", "wer") for e in ("", *(f"_{x}" for x in _ERRORS))), "whisper_cer", "whisper_cer_delete", "whisper_wer", "asr_match_error_rate"),
    "semantic": ("clap_score", *(f"speech_{k}" for k in ("bert", "bleu", "token_distance"))),
    "similarity": tuple(f"{k}_similarity" for k in ("emotion", "singer", "spk")),
    "pitch_f0": ("f0_corr", "f0_rmse", "mcd"),
    "audio_features": ("log_wmse", "speaking_rate"),
    "aesthetics": tuple(f"audiobox_aesthetics_{k}" for k in ("CE", "CU", "PC", "PQ")),
    "security": ("asvspoof_score", "nomad"),
    "other_metrics": ("apa",),
}
#: Then parts of the lower-case name; all groups of a rule must be met by one part each.
PARTS: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = (
    ("similarity", (("sim",),)),
    ("chroma", (("chroma",),)),
    ("dtw", (("dtw",),)),
    ("spectral", (("mel", "mfcc", "spectral"),)),
    ("pitch_f0", (("f0", "fundamental", "pitch"),)),
    ("energy", (("energy", "power", "rms"),)),
    ("rhythm", (("beat", "rhythm", "tempo"),)),
    ("distance", (("cosine", "distance", "euclidean"),)),
    ("correlation", (("corr",),)),
    ("asr_wer_cer", (("cer", "wer"), _ERRORS)),
    ("speech_enhancement", (("pesq", "sar", "sdr", "sir", "stoi"),)),
    ("audio_quality", (("mos", "quality"),)),
)
HIGHER, LOWER = True, False
DIRECTION: tuple[tuple[bool | None, tuple[str, ...], str | None], ...] = (
    (HIGHER, ("sim", "corr"), None),
    (HIGHER, ("mos", "quality", "nisqa", "pesq", "stoi"), None),
    (HIGHER, ("sdr", "sir", "sar", "si-snr", "si_snr"), None),
    (LOWER, ("wer", "cer", "error", "rmse"), None),
    (LOWER, ("distance", "dtw"), "cosine"),
    (LOWER, ("mcd",), None),
    (None, ("spoof",), None),
    (HIGHER, ("clap",), None),
)
RANGES: tuple[tuple[tuple[str, ...], float | None, float | None, str], ...] = (
    (("similarity",), 0, 1, "Unusual range for similarity metric (expected 0-1)"),
    (("correlation",), -1, 1, "Unusual range for correlation metric (expected -1 to 1)"),
    (("mos", "nisqa"), 1, 5, "Unusual range for MOS-scale metric (expected 1-5)"),
    (("pesq",), -0.5, 4.5, "Unusual range for PESQ metric (expected -0.5 to 4.5)"),
    (("stoi",), 0, 1, "Unusual range for STOI metric (expected 0-1)"),
    (("wer", "cer"), 0, None, "Negative error rates detected - check calculation"),
)
NOTES = {
    "low": "Low variability - metric might not be discriminative",
    "very_high": "Very high variability - check for outliers or measurement issues",
    "high": "High variability - good discriminative power",
    "moderate": "Moderate variability - reasonable discriminative power",
}


def ignored(name: Column) -> Column:
    """Names that are no metric: private ones, the key and texts."""
    return name.startswith("_") | (name == "key") | F.lower(name).contains("text")


def category(name: Column) -> Column:
    low = F.lower(name)
    out = None
    for label, names in EXACT.items():
        test = name.isin(*names)
        out = F.when(test, label) if out is None else out.when(test, label)
    for label, groups in PARTS:
        test = F.lit(True)
        for parts in groups:
            test = test & contains_any(low, parts)
        out = out.when(test, label)
    return out.otherwise("other")


def higher_is_better(name: Column) -> Column:
    """True, False, or null where the name doesn't tell."""
    low = F.lower(name)
    out = None
    for value, parts, without in DIRECTION:
        test = contains_any(low, parts)
        if without:
            test = test & ~low.contains(without)
        value = F.lit(value).cast("boolean")
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def variability(cv: Column) -> Column:
    return F.when(cv < 0.1, "low").when(cv > 2.0, "very_high").when(cv > 0.5, "high").otherwise("moderate")


def quality_note(cv: Column) -> Column:
    return F.when(cv < 0.1, NOTES["low"]).when(cv > 2.0, NOTES["very_high"]).when(cv > 0.5, NOTES["high"]).otherwise(NOTES["moderate"])


def range_note(name: Column, low: Column, high: Column) -> Column:
    out = F.when(high - low == 0, "All values identical - no discriminative power")
    for parts, least, most, note in RANGES:
        beyond = F.lit(False)
        if least is not None:
            beyond = beyond | (low < least)
        if most is not None:
            beyond = beyond | (high > most)
        out = out.when(contains_any(F.lower(name), parts) & beyond, note)
    return out


def category_sql(name: str) -> str:
    """The same CASE as SQL text."""
    rules = [f"WHEN {name} IN ({', '.join(repr(n) for n in names)}) THEN '{label}'" for label, names in EXACT.items()]
    for label, groups in PARTS:
        test = " AND ".join("(" + " OR ".join(f"contains(lower({name}), '{p}')" for p in parts) + ")" for parts in groups)
        rules.append(f"WHEN {test} THEN '{label}'")
    return "CASE " + " ".join(rules) + " ELSE 'other' END"


def direction_sql(name: str) -> str:
    rules = []
    for value, parts, without in DIRECTION:
        test = "(" + " OR ".join(f"contains(lower({name}), '{p}')" for p in parts) + ")" + (f" AND NOT contains(lower({name}), '{without}')" if without else "")
        rules.append(f"WHEN {test} THEN {'NULL' if value is None else str(value).upper()}")
    return "CAST(CASE " + " ".join(rules) + " ELSE NULL END AS BOOLEAN)"


def range_sql(name: str, low: str, high: str) -> str:
    rules = [f"WHEN {high} - {low} = 0 THEN 'All values identical - no discriminative power'"]
    for parts, least, most, note in RANGES:
        beyond = " OR ".join(x for x in (f"{low} < {least}" if least is not None else "", f"{high} > {most}" if most is not None else "") if x)
        rules.append(f"WHEN ({' OR '.join(f'contains(lower({name}), {p!r})' for p in parts)}) AND ({beyond}) THEN '{note}'")
    return "CASE " + " ".join(rules) + " ELSE NULL END"
