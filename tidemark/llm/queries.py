"""The registered queries of the training-data operators."""

from tidemark.llm import (  # noqa: F401
    chat,
    decontaminate,
    exact_dedup,
    html_text,
    language_id,
    near_dedup,
    packing,
    secret_scan,
    spelling,
    substring_dedup,
    suffix_dedup,
    url_filters,
    whitening,
)
from tidemark.llm.common import ORACLES, QUERIES  # noqa: F401
