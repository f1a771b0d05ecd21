"""Rule sets as column expressions: ordered rules, weighted scores and the confidence gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authsignal.config import SCORE_ORDER, SCORE_WEIGHTS, UNKNOWN, DetectorConfig
from authsignal.functions.columns import first_match

EXPOSED = "suci_unencrypted = 1"
DOWNGRADED = "reg_rejects >= 1 AND sec_mode_cmds >= 1"


def _first(rules: list[tuple[str, str]], otherwise: Column | str) -> Column:
    """Class of the first rule that holds. The chain is one expression inside generated code."""
    return first_match([(F.expr(condition), name) for condition, name in rules], otherwise)


def online_class(cfg: DetectorConfig = DetectorConfig(), otherwise: Column | str = "model") -> Column:
    """Definitive rules of the online detector, on features after the whole-capture overrides."""
    rules = [
        (EXPOSED, "supi_harvest"),
        (DOWNGRADED, "bidding_down"),
        (f"auth_failures >= {cfg.online_failures}", "brute_force"),
        ("sctp_abort >= 1", "replay"),
        (f"ng_setup_req = {cfg.rogue_sentinel}", "false_bs"),
    ]
    return _first(rules, otherwise)


def simple_class() -> Column:
    """First-match rules of the plain detector."""
    rules = [
        (EXPOSED, "supi_harvest"),
        (DOWNGRADED, "bidding_down"),
        ("ng_setup_req >= 1 AND reg_rejects = 0 AND suci_unencrypted = 0", "false_bs"),
        ("rand_repeat = 1 OR sctp_abort = 1", "replay"),
        ("auth_failures > 0 OR (auth_rate > 0.03D AND auth_success_rate < 0.5D)", "brute_force"),
    ]
    return _first(rules, "normal")


def offline_class(otherwise: Column | str = "model") -> Column:
    """Rules of the offline hybrid; whatever they leave goes to the model."""
    rules = [
        (EXPOSED, "supi_harvest"),
        (DOWNGRADED, "bidding_down"),
        ("auth_failures > 0", "brute_force"),
        ("sctp_abort = 1", "replay"),
    ]
    return _first(rules, otherwise)


# ---- fixed values: conditions of the weighted detector and their weight in tenths ----
WEIGHTED_CONDITIONS = {
    "brute_force": (
        ("auth_failures > 0", 10),
        ("auth_rate > 0.03D", 3),
        ("auth_success_rate < 0.5D AND auth_requests >= 1", 3),
        ("reg_rejects = 0 AND auth_requests >= 1 AND suci_unencrypted = 0", 2),
    ),
    "supi_harvest": (("suci_unencrypted = 1", 10),),
    "bidding_down": (
        ("reg_rejects >= 1", 5),
        ("sec_mode_cmds >= 1 AND reg_rejects >= 1", 4),
        ("reject_rate >= 0.3D", 2),
    ),
    "false_bs": (
        ("ng_setup_req >= 1 AND reg_rejects = 0", 6),
        ("ng_setup_req >= 1 AND auth_requests >= 1", 3),
    ),
    "replay": (("rand_repeat = 1 OR sctp_abort = 1", 10),),
    "normal": (
        ("suci_unencrypted = 0 AND rand_repeat = 0", 2),
        ("reg_rejects = 0 AND auth_success_rate >= 0.8D", 3),
        ("reject_rate = 0 AND ng_setup_req = 0", 2),
    ),
}


def with_weighted_scores(rows: DataFrame) -> DataFrame:
    """Adds ``score_<class>`` in tenths for the six classes."""
    scores = [
        " + ".join(f"if({condition}, {weight}, 0)" for condition, weight in parts) + f" AS score_{name}"
        for name, parts in WEIGHTED_CONDITIONS.items()
    ]
    return rows.selectExpr("*", *scores)


# the highest score and its class as one number: the score times eight, plus a rank that settles ties
_BEST = "greatest(" + ", ".join(
    f"score_{name} * 8 + {len(SCORE_ORDER) - 1 - i}" for i, name in enumerate(SCORE_ORDER)
) + ")"


def weighted_class() -> Column:
    """Class of the highest score on rows from :func:`with_weighted_scores`; ties go to the first."""
    names = ", ".join(f"'{name}'" for name in reversed(SCORE_ORDER))
    return F.expr(f"elt({_BEST} % 8 + 1, {names})")


def score_share() -> Column:
    """Share of the highest score in all six, a confidence that needs no model."""
    total = " + ".join(f"score_{name}" for name in SCORE_ORDER)
    return F.expr(f"({_BEST} div 8) / greatest({total}, 1)")


def window_score() -> Column:
    """How suspicious a window looks; used to pick one window per capture."""
    return F.expr(" + ".join(f"{weight}L * {name}" for name, weight in SCORE_WEIGHTS.items()))


def gated(prediction: Column, confidence: Column, cfg: DetectorConfig = DetectorConfig()) -> Column:
    """Model verdicts below the gate become unknown; a verdict exactly at the gate is kept."""
    return F.when(confidence < cfg.confidence_gate, F.lit(UNKNOWN)).otherwise(prediction)
