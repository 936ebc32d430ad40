"""Column expressions that read labels, names and units."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the phases and of marker channels.
BASELINE_TERMS = ["baseline", "basal", "before", "pre", "pretreatment", "control"]
POST_TERMS = ["post", "after", "recovery", "washout"]
MARKERS = ["marker", "ttl", "trigger", "event", "digital", "dig", "din", "dout", "stim", "sync"]
#: Spellings of each canonical column, in order of preference.
ALIASES = {
    "recording_name": ("recording_name", "recording", "recording_id", "file_name", "filename"),
    "epoch_label": ("epoch_label", "epoch", "condition", "condition_label"),
    "channel": ("channel", "chan", "electrode", "electrode_id"),
    "window_index": ("window_index", "window", "bin", "bin_index"),
    "window_start_s": ("window_start_s", "start_s", "window_start", "start_time_s"),
    "window_end_s": ("window_end_s", "end_s", "window_end", "end_time_s"),
    "window_label": ("window_label", "window_name", "bin_label"),
    "spike_count": ("spike_count", "spikes", "spike_counts", "count", "n_spikes"),
    "window_duration_s": ("window_duration_s", "duration_s", "duration", "window_length_s"),
}
#: Plot labels by what an epoch's name holds, first match wins.
PLOT_LABELS = [("baseline", "Baseline"), ("h2o2", "H2O2 at 0.25 Atm"), ("81na", "-80 nA"), ("90na", "-90 nA"), ("70na", "-70 nA"), ("60na", "-60 nA"), ("50na", "-50 nA")]


#: Names that a list of phases or comparisons may use; `all` stands for each.
PHASE_NAMES = {
    "Baseline": ("baseline", "base", "pre", "control"),
    "Stimulation": ("stimulation", "stim", "current"),
    "Post": ("post", "after", "recovery"),
}
COMPARISON_NAMES = {
    "Baseline": ("baseline", "baseline_halves", "baseline_split", "control"),
    "Stimulation": ("stimulation", "stim", "current"),
    "Post": ("post", "after", "recovery"),
}
#: Runs of what counts as a space in a name.
SPACES = r"[\s\-./()_]+"


def normalised(c: Column) -> Column:
    """Lower case, with one underscore for each run of spaces and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), SPACES, "_"), F.lit("_"))


def plain_name(text: str) -> str:
    """As `normalised`, of a Python string."""
    return re.sub(SPACES, "_", text.strip().lower()).strip("_")


def named(request: str | list[str] | None, names: dict[str, tuple[str, ...]]) -> list[str]:
    """The phases that a comma-separated list asks for, each once; all without a request."""
    pieces = request.split(",") if isinstance(request, str) else request or []
    known = {alias: phase for phase, aliases in names.items() for alias in aliases}
    out: dict[str, None] = {}
    for piece in filter(None, map(plain_name, pieces)):
        if piece != "all" and piece not in known:
            raise ValueError(f"unknown phase {piece!r}; known are all, {', '.join(sorted(known))}")
        out |= dict.fromkeys(names if piece == "all" else [known[piece]])
    return list(out) or list(names)


def recorded_phases(request: str | list[str] | None = None) -> list[str]:
    """Phases to keep. Baseline must be among them, as all is compared with it."""
    out = named(request, PHASE_NAMES)
    if "Baseline" not in out:
        raise ValueError("the baseline must be among the recorded phases")
    return out


def comparisons(request: str | list[str] | None = None, recorded: str | list[str] | None = None) -> list[str]:
    """Comparisons asked for whose phase is recorded; an error if none is left."""
    kept = recorded_phases(recorded)
    out = [c for c in named(request, COMPARISON_NAMES) if c in kept]
    if not out:
        raise ValueError("no comparison is left for the recorded phases")
    return out


def phase(label: Column) -> Column:
    """Baseline, Post or Stimulation by what the label holds; blank and 'nan' have none.

    A term counts anywhere, so 'pressure' is a baseline for its 'pre'.
    """
    bare = F.replace(normalised(label), F.lit("_"), F.lit(""))
    blank = label.isNull() | (F.trim(label) == "") | (F.lower(F.trim(label)) == "nan")
    return F.when(blank, None).when(bare.rlike("|".join(BASELINE_TERMS)), "Baseline").when(bare.rlike("|".join(POST_TERMS)), "Post").otherwise("Stimulation")


def clean_post(label: Column) -> Column:
    text = F.regexp_replace(F.trim(label), r"\s+", " ")
    return F.when(text == "", "Post").otherwise(text)


def clean_stimulation(label: Column) -> Column:
    """One space between words, and between a number and its unit of current."""
    text = F.regexp_replace(F.regexp_replace(F.trim(label), r"\s+", " "), r"(?i)([-+]?\d+(?:\.\d+)?)\s*([munp]?a)\b", "$1 $2")
    return F.when(text == "", "Stimulation").otherwise(text)


def plot_label(label: Column) -> Column:
    low, out = F.lower(F.trim(label)), F.trim(label)
    for term, shown in reversed(PLOT_LABELS):
        out = F.when(F.contains(low, F.lit(term)), shown).otherwise(out)
    return out


def condition_of_file(stem: Column) -> Column:
    low = F.lower(stem)
    has = lambda x: F.contains(low, F.lit(x))
    return F.when(has("pbs") | has("vehicle"), "PBS").when(has("base"), "Baseline").when(has("6"), "Post(-70nA)").when(has("1"), "Post(-1V)").otherwise("Unknown")


def animal_of_file(stem: Column) -> Column:
    return F.substring_index(stem, "_", 1)


def micrometres(size: Column) -> Column:
    """'1.5 mm' is 1500; micrometres and bare numbers stay."""
    text = F.lower(F.trim(size))
    number = F.regexp_extract(text, r"([-+]?\d*\.?\d+)", 1).try_cast("double")
    return F.when(F.contains(text, F.lit("mm")), number * 1000).otherwise(number)


def is_marker(channel: Column) -> Column:
    return normalised(channel).rlike("|".join(MARKERS))


def renames(columns: list[str]) -> dict[str, str]:
    """Old to canonical column names; the first alias that is there wins."""
    there = {plain_name(c): c for c in columns}
    return {there[a]: k for k, names in ALIASES.items() for a in [next((a for a in names if a in there), None)] if a}


def stars(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "n/a").when(p < 1e-4, "****").when(p < 1e-3, "***").when(p < 1e-2, "**").when(p < 0.05, "*").otherwise("ns")
