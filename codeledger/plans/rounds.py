"""Whole rounds: from inquiries to logged rows, and from questions to a logged rerun."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeledger import schemas
from codeledger.functions.payload import typed, usable_json, with_payloads
from codeledger.operators import followup
from codeledger.operators.requests import admitted, question_text
from codeledger.plans.pipeline import FAILED, Calls, Prompts, ask_questions, followup_retry, three_steps
from codeledger.streaming.intake import log_cases, loggable


def classification_round(
    inquiries: DataFrame,
    verified: DataFrame,
    prompts: Prompts,
    calls: Calls,
    work_dir: str,
    history_path: str,
    batch: str,
    *,
    files: str | None = None,
    grain: str = "day",
    store: str | None = None,
) -> DataFrame:
    """Admit, ask in three steps, decide, look up, and log as the named batch of the ledger.

    Returns the inquiries with their answers. Those that need follow-up are not logged; they go on to
    :func:`ask_round`. Nor are those of which a call failed (``failed``): the round run again as the same
    batch, with the same folder or ``store``, asks only what is missing and logs them, too. ``files`` names a column with an array of attachment payloads
    (``sources.attachments.by_request``), which goes into the first step only.
    """
    answered = three_steps(admitted(inquiries), prompts, calls, work_dir, files=files, answers=store)
    log_cases(loggable(answered.filter(F.col(FAILED).isNull())), verified, history_path, batch, grain=grain)
    return answered


def ask_round(
    cases: DataFrame, prompts: Prompts, calls: Calls, work_dir: str, *, limit: int | None = None, store: str | None = None
) -> DataFrame:
    """The questions to inquiries that need follow-up, one a row: ``row_id, pos, question``."""
    if FAILED in cases.columns:
        cases = cases.filter(F.col(FAILED).isNull())
    open_cases = with_payloads(cases.filter(followup.needs_followup(typed(usable_json("raw2"), schemas.STEP2))))
    asked = ask_questions(open_cases, question_text(open_cases), prompts, calls, work_dir, answers=store)
    return followup.question_rows(asked, limit=limit)


def followup_round(
    cases: DataFrame,
    answers: DataFrame,
    prompts: Prompts,
    calls: Calls,
    work_dir: str,
    history_path: str,
    batch: str,
    *,
    eligible: Callable[[DataFrame], Column] | None = None,
    files: str | None = None,
    grain: str = "day",
    store: str | None = None,
) -> DataFrame:
    """Rerun the inquiries whose questions are all answered, and log every rerun, however it ended, unless a call failed.

    Returns all cases with ``round`` and ``qa``. A rerun is logged with the answers given and
    without a note on earlier confirmations.
    """
    both = followup_retry(cases, answers, prompts, calls, work_dir, eligible=eligible, files=files, store=store)
    log_cases(loggable(both.filter((F.col("round") > 1) & F.col(FAILED).isNull())), None, history_path, batch, grain=grain)
    return both
