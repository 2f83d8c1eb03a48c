"""Lexical Go source expressions, all JVM-side (no Python UDF).

The engine never builds a syntax tree. A file's text is tokenised once with a
possessive regular expression, comments and literals are *masked* (same length,
newlines kept) so that brace and parenthesis counting sees code only, and every
later fact is read from the masked text with the original text available at the
same offsets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns. Quantifiers are possessive so that very long literals and
# comments do not overflow the Java regex stack.
TOKEN_PATTERN = (
    r"""(?s)("[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|`[^`]*+`|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"""
    r"""|//[^\n]*+|/\*.*?\*/|[^"`'/]++|.)"""
)

# A valid test header on the masked, single-line header text: name starts with
# Test, no receiver, no type parameters, exactly one parameter field of type
# *testing.T (names optional, several names allowed), no results.
TEST_HEADER_PATTERN = (
    r"^\s*func\s+Test\w*\s*\(\s*(?:\w+(?:\s*,\s*\w+)*\s+)?\*\s*testing\s*\.\s*T\s*,?\s*\)\s*\{"
)

# Function declaration header on a masked line at depth 0.
FUNC_LINE_PATTERN = r"^\s*func\b"
FUNC_NAME_PATTERN = r"^\s*func\s*(?:\([^)]*\)\s*)?(\w+)"
RECEIVER_PATTERN = r"^\s*func\s*\("

COMMENT_FILL = " "
LITERAL_FILL = '"'


def tokens(content: Column) -> Column:
    """Array of lexical tokens; concatenated they give back the input."""
    return F.regexp_extract_all(content, F.lit(TOKEN_PATTERN), 1)


def mask(content: Column) -> Column:
    """Comments become blanks, string/rune literals become the filler ``"``.

    Output has the same length and the same newlines as the input, so line
    numbers and columns stay valid for the original text.
    """
    def one(t: Column) -> Column:
        return (
            F.when(t.startswith("//") | t.startswith("/*"),
                   F.regexp_replace(t, r"[^\n]", COMMENT_FILL))
            .when(t.startswith('"') | t.startswith("`") | t.startswith("'"),
                  F.regexp_replace(t, r"[^\n]", LITERAL_FILL))
            .otherwise(t)
        )
    return F.array_join(F.transform(tokens(content), one), "")


def count_char(s: Column, ch: str) -> Column:
    """Occurrences of one ASCII character in ``s``."""
    return F.octet_length(s) - F.octet_length(F.replace(s, F.lit(ch), F.lit("")))


def brace_delta(masked_line: Column) -> Column:
    return count_char(masked_line, "{") - count_char(masked_line, "}")


def paren_delta(masked_line: Column) -> Column:
    return count_char(masked_line, "(") - count_char(masked_line, ")")
