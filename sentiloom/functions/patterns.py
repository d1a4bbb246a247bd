"""Character classes spelled out so that every engine reads them alike.

Python's \\w, \\s and \\d are Unicode, Java's and RE2's are ASCII; explicit
classes keep the meaning of the former in all of them.
"""

SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
WS = f"[{SPACE}]"
NWS = f"[^{SPACE}]"
WORD = r"[\p{L}\p{N}_]"
NWORD = r"[^\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"

URL = f"http{NWS}+|www{NWS}+|https{NWS}+"
EMAIL = f"{NWS}+@{NWS}+"
AT_NAME = f"@{WORD}+"
USER_PATH = f"u/{WORD}+"
FORUM_PATH = f"r/{WORD}+"
HASHTAG = f"#({WORD}+)"
NOT_PLAIN_KEEP_DOLLAR = f"[^a-zA-Z0-9${SPACE}]"
NOT_PLAIN = f"[^a-zA-Z0-9{SPACE}]"
NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_" + SPACE + "]"
TERM = WORD + "{2,}"
PRICE = r"\$" + DIGIT + "+"
PERCENT = DIGIT + "+%"
ADVANCED_PRICE = r"\$" + DIGIT + r"+[," + DIGIT + r"]*\.?" + DIGIT + "*[kKmMbB]?"
ADVANCED_PERCENT = DIGIT + r"+\.?" + DIGIT + "*%"
TICKER = r"\$([A-Z]{2,5})\b"
SENTENCE_END = r"[.!?]+"
SENTENCE_END_SPACED = r"[.!?]+(" + WS + "|$)"
VOWEL_GROUP = "[aeiouy]+"


def whole_word(words: list[str]) -> str:
    """Pattern that finds any of ``words`` standing as a whole word."""
    return f"(^|{NWORD})({'|'.join(words)})({NWORD}|$)"
