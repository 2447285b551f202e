"""Review predicates over segment columns (NULL-safe)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

REVIEW_BELOW = 0.84
CRITICAL_BELOW = 0.70
VOICE_BELOW = 0.72


def _done(state: Column) -> Column:
    return F.coalesce(state.isin("accepted", "corrected", "ignored"), F.lit(False))


def _below(c: Column, limit: float) -> Column:
    return F.coalesce(c < limit, F.lit(False))


def needs_text_review(reasons: Column | None = None) -> Column:
    state = F.col("review_state")
    listed = F.lit(False) if reasons is None else F.coalesce(F.size(reasons) > 0, F.lit(False))
    return ~_done(state) & (F.coalesce(state == "pending", F.lit(False)) | listed
                            | _below(F.col("confidence"), REVIEW_BELOW))


def needs_speaker_review() -> Column:
    return ~_done(F.col("speaker_review_state")) & (
        _below(F.col("speaker_confidence"), VOICE_BELOW)
        | _below(F.col("speaker_match_confidence"), VOICE_BELOW))


def needs_review(reasons: Column | None = None) -> Column:
    return needs_text_review(reasons) | needs_speaker_review()


def confidence_tone(c: Column) -> Column:
    return F.when(c < CRITICAL_BELOW, "critical").when(c < REVIEW_BELOW, "warning").otherwise("good")


def text_is_suspicious() -> Column:
    return F.col("text").rlike("[�ÃÂ]") | (F.coalesce(F.col("confidence"), F.lit(0.0)) < REVIEW_BELOW)


def filter_segments(df, query: str = "", review_only: bool = False):
    if query.strip():
        df = df.where(F.lower("text").contains(query.lower()))
    return df.where(needs_review()) if review_only else df
