"""Formats, patterns and limits that decide the results.

Everything here is a constant that two implementations have to share to agree
on ids, texts and counts.  Patterns are Java regular expressions.
"""

# Corpus limits and file naming.
FIRST_YEAR = 2017
FIRST_TITLE = 1
LAST_TITLE = 50
TITLE_FILE_SUFFIX = ".xml.gzip"
TITLE_FILE_PREFIX = "Title"
TITLE_FILE_FORMAT = "Title-%02d-%d.xml.gzip"
TITLE_URL_FORMAT = "https://www.ecfr.gov/api/versioner/v1/full/%d-12-31/title-%d.xml"

# Fetch outcomes.
STATUS_PRESENT = "Present"
STATUS_ABSENT = "Absent"
STATUS_ACQUIRED = "Acquired"
STATUS_FAILED = "Failed"
CODE_OK = 200
CODE_NOT_QUERIED = 299
CODE_RATE_LIMITED = 429
CODE_TIMEOUT = 599

# Element and attribute names of the corpus markup.
PART_LEVEL = 5
SECTION_LEVEL = 8
APPENDIX_LEVEL = 9
TYPE_ATTRIBUTE = "TYPE"
NUMBER_ATTRIBUTE = "N"
HEADING_ELEMENT = "HEAD"
AUTHORITY_ELEMENT = "AUTH"

# Section identifiers.
SECTION_TYPE = "SECTION"
APPENDIX_TYPE = "APPENDIX"
RAW_ID_SEPARATOR = "[-]"
ID_WIDTH = 4
PART_PREFIX = "Part-"
SECTION_PREFIX = "Section-"
RAW_PART_PREFIX = "PART-"
AFTER_FIRST_DOT = "[.].+$"
UP_TO_LAST_DOT = "^.+[.]"
UP_TO_LAST_TO = ".* to "
UP_TO_LAST_PART = ".*Part "
FROM_FIRST_TO = " to .*"
APPENDIX_WORD = "Appendix |Appendixes "
APPENDIX_PREFIX = "Appendix-"
TRAILING_YEAR = r"-(\d{4})$"
LABEL_PREFIX = "^([A-Za-z]+)-0*"
LABEL_REPLACEMENT = "$1 "

# Section text and authority text.
SECTION_SIGN = "§"
LINE_BREAK = " *\n *"
BLANKS = r"\s+"
AUTHORITY_HEAD = "Authority: "
AUTHORITY_AND = ", and "
AUTHORITY_SEPARATOR = ", "
LAST_CHARACTER = ".$"
RESERVED = "RESERVED"

# Labels, rounding and default parameters.
LEAST = "Least"
MOST = "Most"
NEITHER = "Neither"
SCORE_DIGITS = 6
DISPLAY_DIGITS = 3
FOCAL_YEAR = 2024
DEVIANTS_N = 1
ENCODER_BATCH = 32
