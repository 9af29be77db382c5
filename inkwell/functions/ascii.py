"""Case folding of A-Z alone."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters outside ASCII whose lower case holds an ASCII letter.
_FOLDS_TO_ASCII = "[İK]"


def ascii_lower(text: Column) -> Column:
    """text with A-Z lower-cased and every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_case(text: Column) -> Column:
    """text lower-cased for word matching in ASCII: as ascii_lower() for all ASCII characters, but faster.

    lower() also changes letters outside ASCII, to others outside ASCII but for two of them; texts with
    those two take the slower way.
    """
    return F.when(text.rlike(_FOLDS_TO_ASCII), ascii_lower(text)).otherwise(F.lower(text))
