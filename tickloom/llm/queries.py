"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import chat_format, resample, url_filter, warc
from .align import op12_tokenizer_alignment
from .chat_format import op1_chat_format
from .decontaminate import op9_decontamination
from .html_extract import op5_html_extraction
from .language import op3_language_id
from .line_clean import op2_line_cleaning
from .ngram_join import op4_ngram_jaccard_join
from .packing import op8_packing
from .quality import op7_quality
from .resample import op11_importance_resampling
from .secret_scan import op6_secret_scan
from .url_filter import op10_url_filter
from .warc import op13_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_line_cleaning, op3_language_id, op4_ngram_jaccard_join, op5_html_extraction,
        op6_secret_scan, op7_quality, op8_packing, op9_decontamination, op10_url_filter,
        op11_importance_resampling, op12_tokenizer_alignment, op13_warc,
    )
}

#: The others have no SQL; tests/llm compares them with brute force, round trips or held-out labels.
ORACLES = {"op1_chat_format": chat_format.SQL, "op10_url_filter": url_filter.SQL, "op11_importance_resampling": resample.SQL, "op13_warc": warc.SQL}
