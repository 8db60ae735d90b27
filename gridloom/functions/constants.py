"""Fixed values of the data model."""

# Cells that count as missing, case-sensitive.
MISSING_MARKERS = ["", "N/A", "n/a", "NA", "na", "NULL", "null", "NaN", "nan", "None", "none", "-", "--", "?", "미입력", "#N/A", "#REF!", ".", ".."]

# A row that contains one of these is a summary row.
SUMMARY_KEYWORDS = ["합계", "총합계", "소계", "subtotal", "total", "grand total", "sum", "average", "평균", "※", "주)", "자료:", "작성", "단위:", "생성일", "report generated", "tax"]

# Strings that read as null on the parse path; matched as they are.
NAN_LIKE = ["N/A", "NA", "NaN", "null", "Null", "NULL", "None", "(empty)", "(blank)", "--", "?", "*", "-", "999", "-1", "Not Applicable", "No Data", "Missing"]

# In-cell delimiters, in the order in which ties are settled.
FEATURE_DELIMITERS = [",", ";", "/", "|", "ㆍ", "&", ":"]
MULTIVALUE_DELIMITERS = [",", ";", "/", "|"]

# Field delimiters of a text grid, in the order in which ties are settled.
GRID_DELIMITERS = [",", ";", "\t", "|"]

# White space at the ends of a cell.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Patterns of dates, labels and numbers.
DATE_ANYWHERE = r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{8}"
MONTHS = "jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|jun(e)?|jul(y)?|aug(ust)?|sep(t)?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?"
MONTH_OR_QUARTER = rf"^\s*({MONTHS}|q[1-4]|[1-4]\s*분기|1[0-2]?월|[1-9]월)\s*$"
PERIOD_TOKEN = r"^(wk|week|w|day|d|t|period|p)\s*_?\d{1,3}$"
ID_HINT = r"\bid\b|\bno\.?\b|\bindex\b|\bcode\b|\bkey\b|\bseq\b|id$|번호|코드|일련|연도|년도"
SINGLE_DATE = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}$|^\d{{1,2}}[/.]\d{{1,2}}[/.]\d{{2,4}}$|^({MONTHS})\.?\s+\d{{1,2}},?\s+\d{{4}}$|^\d{{1,2}}\s+({MONTHS})\.?,?\s+\d{{4}}$"
FLOAT = r"^\s*[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
NUMBER_DRESS = r"^['\"$₩]|[원만USD%\s]+$"
DAY, MONEY, EURO = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$", r"^[\$₩€£]\s*([\d,]+\.?\d*)$", r"^(\d{1,3}(?:\.\d{3})*),(\d+)$"
NOT_FINITE = r"^\s*[+-]?(inf|infinity|nan)\s*$"
