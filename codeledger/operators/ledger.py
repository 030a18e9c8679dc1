"""From a resolved inquiry to its row in the ledger."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeledger import schemas
from codeledger.functions.payload import usable_json
from codeledger.functions.text import fingerprint, shortened
from codeledger.operators.audit import WHOLE, Shown, decision_tree
from codeledger.operators.followup import qa_text

# How much of inputs and answers the short form of the ledger shows.
SHOWN_INPUT = 200
SHOWN_ANSWER = 500

ID_LENGTH = 32
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def request_id(*key: Column | str, length: int = ID_LENGTH) -> Column:
    """A row id derived from the request, so that a repeated write has the same id.

    Eight digits, the length of the random ids this replaces, collide from some ten
    thousand rows on; the default is safe for any ledger.
    """
    return F.left(F.sha2(F.concat_ws("\x1f", *key), 256), F.lit(length))


def history_record(
    resolved: DataFrame, *also: str, qa: str | None = None, row_id: Column | str = "row_id", shown: Shown = WHOLE
) -> DataFrame:
    """The ledger row of each inquiry, from a frame with payloads and result columns.

    Inputs and answers are stored whole; ``shown`` is for the audit text only. Also carries the
    fingerprint of the description, the round (the first, if the frame has none) and, if the
    frame has it, ``verified_by``. ``also`` names further columns to keep.
    """
    step1, step2 = F.col("step1"), F.col("step2")

    def text(value: Column | str) -> Column:
        return F.coalesce(value, F.lit(""))

    no_answers = F.array().cast(schemas.QA_PAIRS)
    values = {
        "timestamp": F.col("timestamp"),
        "user": text("user"),
        "description": text("description"),
        "specs": text("specs"),
        "has_image": F.coalesce("has_image", F.lit(False)),
        "has_invoice": F.coalesce("has_invoice", F.lit(False)),
        "product_id": text(step1.product_identification),
        "category": text(step1.category_hint),
        "data_quality": text(step1.data_quality),
        "cn_code": text(step2.cn_code),
        "taric_code": text(step2.taric_code),
        "confidence": text(step2.confidence),
        "outcome": F.col("outcome"),
        "validated_code": F.col("code"),
        "manual_review": F.col("manual"),
        "issues": F.col("result_issues"),
        "decision_tree": decision_tree(resolved, qa=qa, shown=shown),
        "raw_step1": F.coalesce("json1", text("raw1")),
        "raw_step2": text("raw2"),
        "raw_step3": text("raw3"),
        "followup_qa": no_answers if qa is None else F.coalesce(F.col(qa), no_answers),
        "senior_reviewed": F.lit(False),
        "senior_user": F.lit(""),
        "senior_timestamp": F.lit(None).cast("timestamp_ntz"),
        "senior_verdict": F.lit(""),
        "senior_comment": F.lit(""),
        "row_id": row_id if isinstance(row_id, Column) else F.col(row_id),
    }
    mark = F.col("product_fingerprint") if "product_fingerprint" in resolved.columns else fingerprint("description")
    turn = F.coalesce(F.col("round").cast("int"), F.lit(1)) if "round" in resolved.columns else F.lit(1)
    note = F.col("verified_by") if "verified_by" in resolved.columns else F.lit(None).cast("string")
    return resolved.select(
        *(value.alias(name) for name, value in values.items()),
        mark.alias("product_fingerprint"),
        note.alias("verified_by"),
        turn.alias("round"),
        *also,
    )


def history_text(
    history: DataFrame, *also: str, input_width: int | None = None, answer_width: int | None = None
) -> DataFrame:
    """The ledger as text in header order: yes/no flags, joined lists, blanks for nulls.

    ``also`` names further columns to keep as they are. With ``input_width`` description and
    specs are shown cut, with ``answer_width`` the answers; a first answer that is a payload
    stays whole.
    """
    widths = dict.fromkeys(("description", "specs"), input_width)
    widths |= dict.fromkeys(("raw_step1", "raw_step2", "raw_step3"), answer_width)

    def shown(field: T.StructField) -> Column:
        value = F.col(field.name)
        if field.dataType == T.BooleanType():
            value = F.when(value, "yes").otherwise("no")
        elif field.dataType == T.TimestampNTZType():
            value = F.date_format(value, TIME_FORMAT)
        elif field.dataType == schemas.QA_PAIRS:
            value = qa_text(value)
        elif isinstance(field.dataType, T.ArrayType):
            value = F.array_join(value, "; ")
        elif (width := widths.get(field.name)) is not None:
            value = shortened(value, width)
            if field.name == "raw_step1":
                value = F.coalesce(usable_json(field.name), value)
        return F.coalesce(value, F.lit("")).alias(field.name)

    return history.select(*(shown(field) for field in schemas.HISTORY), *also)
