"""Block removal and normalisation once more, in plain Python, for one text at a time."""

import re
import unicodedata

from claimloom import fixed_values as fixed

EMAIL = re.compile(fixed.EMAIL_ADDRESS, re.IGNORECASE)


def normal(text):
    text = unicodedata.normalize("NFKC", text)
    gone = set(range(0x20)) - {9, 10, 13} | {0x7F, 0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD}
    return "".join("\n" if ord(c) in (0x2028, 0x2029) else c for c in text if ord(c) not in gone)


def block_lines(text, start, marks):
    """Text without blocks, and the number of starts: looks back from every line."""
    lines = text.split("\n")

    def kind(line):
        line = line.strip()
        if re.match(start, line, re.IGNORECASE):
            return "start"
        more = EMAIL.search(line) or line[-1:] in (",", ";") and line or any(m in line for m in marks)
        return "more" if more else "end"

    kinds = [kind(line) for line in lines]

    def kept(i):
        while i >= 0 and kinds[i] == "more":
            i -= 1
        return i < 0 or kinds[i] == "end"

    return "\n".join(line for i, line in enumerate(lines) if kept(i)), kinds.count("start")


def without_cc(text):
    return block_lines(text, fixed.CC_LINE, "")


def without_addresses(text):
    return block_lines(text, fixed.ADDRESS_LINE, "<>")


def without_disclaimers(text, markers=fixed.BLOCK_MARKERS, endings=fixed.BLOCK_ENDINGS):
    flags = re.IGNORECASE | re.DOTALL
    for blocks in range(fixed.BLOCK_ROUNDS):
        found = next((m for m in (re.search(p, text, flags) for p in markers) if m), None)
        if found is None:
            return text, blocks
        head, rest = text[: found.start()], text[found.start() :]
        end = next((m for m in (re.search(p, rest, re.IGNORECASE) for p in endings) if m), None)
        tail = ""
        if end:
            tail = rest[end.end() :]
            stop = re.search(r"[.\n]", tail[: fixed.SENTENCE_REACH])
            tail = tail[stop.end() :] if stop else tail
        text = head + tail
    return text, fixed.BLOCK_ROUNDS
