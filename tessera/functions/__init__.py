"""Row-local column expressions (F1-F14) and regex text functions."""

from tessera.functions.columns import *  # noqa: F401,F403
from tessera.functions.text import (  # noqa: F401
    SPEC_PREFIXES, clean_rtf, code_parts, extract_specs, segments, segment_boundary, boundary,
)
