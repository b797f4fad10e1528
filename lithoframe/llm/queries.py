"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontam import op5_decontamination
from .fingerprints import near_fingerprints, op3_fingerprints
from .html_blocks import op10_html_extraction
from .licenses import op2_license_scan
from .line_dedup import SQL as LINE_DEDUP_SQL
from .line_dedup import op9_line_dedup
from .near_join import op6_jaccard_join
from .packing import op1_best_fit_packing
from .quality import op7_quality_classifier
from .secrets import op4_secret_scan
from .toxicity import op8_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_license_scan, op3_fingerprints, op4_secret_scan, op5_decontamination,
        op6_jaccard_join, op7_quality_classifier, op8_toxicity, op9_line_dedup, op10_html_extraction, near_fingerprints,
    )
}
ORACLES = {"op9_line_dedup": LINE_DEDUP_SQL}
