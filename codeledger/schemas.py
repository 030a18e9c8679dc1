"""Declared schemas. Codes are strings everywhere: leading zeros matter."""

from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Field names and types of the three step payloads and the question payload.
STEP1 = _struct(
    product_identification=T.StringType(),
    possible_alternatives=_TEXTS,
    materials=_TEXTS,
    composition_details=T.StringType(),
    function=T.StringType(),
    secondary_functions=_TEXTS,
    form=T.StringType(),
    packaging=T.StringType(),
    is_set=T.BooleanType(),
    is_part=T.BooleanType(),
    category_hint=T.StringType(),
    extracted_text=_TEXTS,
    image_observations=_TEXTS,
    missing_information=_TEXTS,
    ambiguities=_TEXTS,
    conflicts=_TEXTS,
    data_quality=T.StringType(),
)
STEP2 = _struct(
    cn_code=T.StringType(),
    taric_code=T.StringType(),
    cn_description=T.StringType(),
    taric_description=T.StringType(),
    candidate_headings=_TEXTS,
    confidence=T.StringType(),
    warnings=_TEXTS,
    manual_review_recommended=T.BooleanType(),
)
STEP3 = _struct(
    validation_outcome=T.StringType(),
    validated_code=T.StringType(),
    taric_code=T.StringType(),
    manual_review_recommended=T.BooleanType(),
    issues=_TEXTS,
    missing_data=_TEXTS,
)
QUESTIONS = _struct(questions=_TEXTS)

# Ordered question -> answer pairs; a map would lose the order.
QA_PAIRS = T.ArrayType(_struct(q=T.StringType(), a=T.StringType()))

# The ledger's columns in header order.
HISTORY = _struct(
    timestamp=T.TimestampNTZType(),
    user=T.StringType(),
    description=T.StringType(),
    specs=T.StringType(),
    has_image=T.BooleanType(),
    has_invoice=T.BooleanType(),
    product_id=T.StringType(),
    category=T.StringType(),
    data_quality=T.StringType(),
    cn_code=T.StringType(),
    taric_code=T.StringType(),
    confidence=T.StringType(),
    outcome=T.StringType(),
    validated_code=T.StringType(),
    manual_review=T.BooleanType(),
    issues=_TEXTS,
    decision_tree=T.StringType(),
    raw_step1=T.StringType(),
    raw_step2=T.StringType(),
    raw_step3=T.StringType(),
    followup_qa=QA_PAIRS,
    senior_reviewed=T.BooleanType(),
    senior_user=T.StringType(),
    senior_timestamp=T.TimestampNTZType(),
    senior_verdict=T.StringType(),
    senior_comment=T.StringType(),
    row_id=T.StringType(),
)

# What the stored ledger carries besides its header: the fingerprint of the description
# (confirmations need it), the round of the inquiry and the two partition columns.
HISTORY_TABLE = T.StructType(
    HISTORY.fields
    + _struct(
        product_fingerprint=T.StringType(),
        verified_by=T.StringType(),
        round=T.IntegerType(),
        event_period=T.DateType(),
        ingest_batch=T.StringType(),
    ).fields
)

# The confirmed-answers table.
VERIFIED = _struct(
    row_id=T.StringType(),
    product_fingerprint=T.StringType(),
    cn_code=T.StringType(),
    taric_code=T.StringType(),
    senior_user=T.StringType(),
    senior_timestamp=T.TimestampNTZType(),
    senior_comment=T.StringType(),
    original_description=T.StringType(),
)

# One inquiry with its three answers side by side. Keeping them on one row makes every
# per-inquiry rule a narrow transformation.
CASES = _struct(
    row_id=T.StringType(),
    timestamp=T.TimestampNTZType(),
    user=T.StringType(),
    description=T.StringType(),
    specs=T.StringType(),
    has_image=T.BooleanType(),
    has_invoice=T.BooleanType(),
    raw1=T.StringType(),
    raw2=T.StringType(),
    raw3=T.StringType(),
)

# What the intake reads: cases, their round (null: the first) and the answers of a rerun.
INTAKE = T.StructType(CASES.fields + _struct(round=T.IntegerType(), qa=QA_PAIRS).fields)
