"""A model function without a model, for tests and the registered pipeline queries.

Its answers depend on nothing but the request, digit for digit, so that SQL can foretell them.
"""

import hashlib
from collections.abc import Sequence

from codeledger.plans.pipeline import Prompts

PROMPTS = Prompts(extract="extract", classify="classify", validate="validate", ask="ask")

_TO_DIGITS = str.maketrans("abcdef", "012345")


def digits_of(system: str, text: str | None) -> str:
    digest = hashlib.md5(f"{system}\n{text or ''}".encode()).hexdigest()
    return digest.translate(_TO_DIGITS)


def stub_model():
    """The factory: returns the model function."""

    def answer(system: str, text: str | None, files: Sequence[dict] = ()) -> str:
        marks = (f"\n{file['media_type']} {hashlib.md5(file['data'].encode()).hexdigest()}" for file in files)
        digits = digits_of(system, (text or "") + "".join(marks))
        if system == PROMPTS.extract:
            return f'{{"product_identification": "item {digits[:6]}", "category_hint": "mixed/other"}}'
        if system == PROMPTS.classify:
            # One in ten finds no code.
            code = "" if digits[8] == "9" else digits[:8]
            return f'Heading {digits[:4]}\n{{"cn_code": "{code}", "confidence": "HIGH"}}'
        if system == PROMPTS.validate:
            return f'{{"validation_outcome": "VALIDATED", "validated_code": "", "taric_code": "{digits[:10]}"}}'
        return f"1. What about {digits[:4]}?"

    return answer


def fails(digits: str) -> bool:
    """Whether the flaky model has no answer: one request in eight."""
    return digits[9] in "89"


def flaky_model():
    """The same model on a bad day."""
    model = stub_model()

    def answer(system: str, text: str | None, *files) -> str:
        if fails(digits_of(system, text)):
            raise RuntimeError("no answer")
        return model(system, text, *files)

    return answer
