"""Parsers and formatters of names, lines and small texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that a name may have: printable ASCII but space, ``/``, ``*`` and ``>``. Its longest length in bytes. Fixed values.
NAME_BYTES, NAME_LONGEST = "!-)+-.0-=?-~", 64
#: What the line-drawing set shows for ``_`` and the characters up to ``~``. Fixed values.
DRAWN_FOR = "_`abcdefghijklmnopqrstuvwxyz{|}~"
DRAWN = " ◆▒␉␌␍␊°±␤␋┘┐┌└┼⎺⎻─⎼⎽├┤┴┬│≤≥π≠£·"
#: Channel values of the colour cube's six levels, and of the sixteen named colours. Fixed values.
CUBE = (0, 95, 135, 175, 215, 255)
NAMED = ("000000", "800000", "008000", "808000", "000080", "800080", "008080", "c0c0c0", "808080", "ff0000", "00ff00", "ffff00", "0000ff", "ff00ff", "00ffff", "ffffff")
#: Milliseconds of a budget's unit: alone, and after a number. Fixed values.
UNIT_ALONE = {"min": 60_000, "m": 60_000, "s": 1_000, "sec": 1_000}
UNIT_COUNTED = {"min": 60_000, "m": 60_000, "ms": 1, "s": 1_000}
#: The most wakes that a budget may allow.
MOST_WAKES = 64
#: Who may drive a turn. Fixed values.
DRIVERS = ("human", "agent", "harness", "local")
DRIVER_LONGEST = 64


def name_verdict(name: Column) -> Column:
    """Ok, Empty, TooLong, or Byte and the first byte that a name may not have."""
    bad = F.regexp_extract(name, f"[^{NAME_BYTES}]", 0)
    return F.when(name == "", "Empty").when(F.octet_length(name) > NAME_LONGEST, "TooLong").when(bad != "", F.concat(F.lit("Byte "), F.substring(F.lower(F.hex(F.encode(bad, "UTF-8"))), 1, 2))).otherwise("Ok")


def escape_user(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("="), F.lit("=3D")), F.lit(","), F.lit("=2C"))


def unescape_user(name: Column) -> Column:
    """Null if an equals sign is not part of an escape."""
    bare = F.contains(F.regexp_replace(name, "=3[Dd]|=2[Cc]", ""), F.lit("="))
    return F.when(~bare, F.regexp_replace(F.regexp_replace(name, "=2[Cc]", ","), "=3[Dd]", "="))


def drawn(text: Column) -> Column:
    """Text in the line-drawing set."""
    return F.translate(text, DRAWN_FOR, DRAWN)


def colour(n: Column) -> Column:
    """Six hex digits of a palette number: sixteen named colours, a cube, a grey ramp."""
    level = lambda i: F.get(F.array(*(F.lit(v) for v in CUBE)), i.cast("int"))
    two = lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))
    i = n - 16
    cube = F.concat(two(level(F.floor(i / 36))), two(level(F.floor(i / 6) % 6)), two(level(i % 6)))
    grey = two((n - 232) * 10 + 8)
    return F.when(n < 16, F.get(F.array(*(F.lit(v) for v in NAMED)), n.cast("int"))).when(n < 232, cube).otherwise(F.concat(grey, grey, grey))


def turn_line(seq: Column, off: Column, cause: Column, kind: Column, who: Column) -> Column:
    """The line of a turn; ``cause`` and ``kind`` are null together."""
    by = F.when(kind.isNull(), F.lit("none")).otherwise(F.concat(kind, F.lit(":"), F.substring(who, 1, DRIVER_LONGEST)))
    return F.concat(F.lit("EVENT turn seq="), seq.cast("string"), F.lit(" off="), off.cast("string"), F.lit(" cause="), F.coalesce(cause.cast("string"), F.lit("-")), F.lit(" by="), by)


def parse_turn_line(line: Column) -> Column:
    """Struct (seq, off, cause, kind, who), null unless each of the four fields is there once, well formed, and the cause not after the turn."""
    words = F.filter(F.split(F.substr(line, F.lit(12)), " "), lambda w: w != "")
    keys = F.array_sort(F.transform(words, lambda w: F.split_part(w, F.lit("="), F.lit(1))))
    value = lambda key: F.substr(F.get(F.filter(words, lambda w: F.startswith(w, F.lit(f"{key}="))), 0), F.lit(len(key) + 2))
    number = lambda c: F.when(c.rlike("^[0-9]{1,18}$"), c.cast("long"))
    cause, by = value("cause"), value("by")
    kind = F.when(by != "none", F.split_part(by, F.lit(":"), F.lit(1)))
    whole = F.startswith(line, F.lit("EVENT turn ")) & (keys == F.array(*(F.lit(k) for k in ("by", "cause", "off", "seq"))))
    good = number(value("seq")).isNotNull() & number(value("off")).isNotNull() & ((cause == "-") | number(cause).isNotNull()) & ((by == "none") | by.rlike(f"^(?:{'|'.join(DRIVERS)}):"))
    fit = ((cause == "-") == (by == "none")) & ((cause == "-") | (number(cause) <= number(value("off"))))
    found = F.struct(number(value("seq")).alias("seq"), number(value("off")).alias("off"), number(cause).alias("cause"), kind.alias("kind"), F.when(by != "none", F.substr(by, F.length(kind) + 2)).alias("who"))
    return F.when(whole & good & fit, found)


def gap_line(low: Column, high: Column, records: Column) -> Column:
    return F.concat(F.lit("GAP from="), low.cast("string"), F.lit(" to="), high.cast("string"), F.lit(" records="), F.coalesce(records.cast("string"), F.lit("unknown")))


def out_subject(session: Column) -> Column:
    return F.concat(F.lit("/a/stream/term/"), session.cast("string"), F.lit("/out"))


def task_subject(queue: Column) -> Column:
    return F.concat(F.lit("/a/stream/tasks/"), queue)


def budget(spec: Column) -> Column:
    """Struct (most, window_ms) of ``<n>/<unit>``; null if it is not one."""
    part = lambda i: F.regexp_extract(spec, "^([0-9]{1,9})/([0-9]{0,9})([a-z]+)$", i)
    unit = lambda units: F.coalesce(*(F.when(part(3) == u, F.lit(v).cast("long")) for u, v in units.items()))
    most = F.when(part(1) != "", part(1).cast("long"))
    window = F.when(part(2) == "", unit(UNIT_ALONE)).otherwise(F.try_multiply(F.when(part(2) != "", part(2).cast("long")), unit(UNIT_COUNTED)))
    return F.when(most.between(1, MOST_WAKES) & (window > 0), F.struct(most.alias("most"), window.alias("window_ms")))


def log_identity(text: Column) -> Column:
    """Struct (id, generation) of ``<32 lower-case hex digits>.<digits>``; null for anything else."""
    part = lambda i: F.regexp_extract(text, r"^([0-9a-f]{32})\.([0-9]{1,18})$", i)
    return F.when(part(1) != "", F.struct(part(1).alias("id"), F.when(part(2) != "", part(2).cast("long")).alias("generation")))


def escalation_rule(line: Column) -> Column:
    """Struct (kind, arg, error) of a line of an escalation table: a rule, the horizon, nothing (comments), or what is wrong."""
    text = F.trim(line)
    words = F.filter(F.split(text, r"[ \t]+"), lambda w: w != "")
    head, arg = F.get(words, 0), F.get(words, 1)
    found = lambda kind, a, error=None: F.struct(kind.alias("kind"), a.alias("arg"), F.lit(error).cast("string").alias("error"))
    none, ms = F.lit(None).cast("string"), F.regexp_extract(text, "^horizon=([0-9]+)ms$", 1)
    return (
        F.when((text == "") | F.startswith(text, F.lit("#")), found(none, none))
        .when(F.startswith(text, F.lit("horizon=")), F.when(ms != "", found(F.lit("horizon"), ms)).otherwise(found(none, none, "horizon")))
        .when(F.size(words) > 2, found(none, none, "words")).when(F.size(words) < 2, found(none, none, "argument"))
        .when(head.isin("subject", "principal", "group"), found(head, arg)).otherwise(found(none, none, "rule"))
    )


def health(text: Column) -> Column:
    """Keys and values of a health file's lines after its first."""
    return F.str_to_map(F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n", ""), r"\n$", ""), F.lit("\n"), F.lit("="))


def producer_id(principal: Column, domain: str = "ledgerline-producer") -> Column:
    """The producer's number, as a long: the first eight bytes, lowest first, of a digest over a domain, a zero byte and the principal."""
    digest = F.sha2(F.concat(F.encode(F.lit(domain), "UTF-8"), F.unhex(F.lit("00")), F.encode(principal, "UTF-8")), 256)
    high = F.concat(*(F.substring(digest, 2 * i + 1, 2) for i in range(7, 3, -1)))
    low = F.concat(*(F.substring(digest, 2 * i + 1, 2) for i in range(3, -1, -1)))
    return F.shiftleft(F.conv(high, 16, 10).cast("long"), 32).bitwiseOR(F.conv(low, 16, 10).cast("long"))


def strict_json(doc: Column) -> Column:
    """A document as a variant; null unless the text is one whole document.

    The parser alone ignores what follows a document. Inside brackets and inside braces at once, nothing can follow.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), doc, F.lit("]"))), "$", "array<variant>")
    inside = F.try_parse_json(F.concat(F.lit('{"a":'), doc, F.lit("}")))
    return F.when((F.size(listed) == 1) & inside.isNotNull(), F.try_parse_json(doc))


COMPLETION = "content array<struct<type:string,text:string,id:string,name:string,input:variant>>, stop_reason string"


def completion(doc: Column) -> Column:
    """Struct (text, tool, input, stop) of a completion document: texts joined, the first tool call; null for what isn't one."""
    whole = F.when(strict_json(doc).isNotNull() & F.startswith(F.trim(doc), F.lit("{")), F.from_json(doc, COMPLETION))
    text = F.array_join(F.transform(F.filter(whole["content"], lambda b: b["type"] == "text"), lambda b: b["text"]), "")
    call = F.get(F.filter(whole["content"], lambda b: b["type"] == "tool_use"), 0)
    return F.when(whole["content"].isNotNull(), F.struct(text.alias("text"), call["name"].alias("tool"), F.to_json(call["input"]).alias("input"), whole["stop_reason"].alias("stop")))


def assembled(chunks, key: list[str], order: str, chunk: str):
    """(key, text, input, stop) of event streams that come in chunks, cut anywhere: texts and partial inputs joined, the last stop reason.

    A stream's chunks are gathered, as one answer is bounded; events are the parts between empty lines, comments are skipped.
    """
    whole = chunks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, chunk))).alias("c"))
    body = F.array_join(F.transform("c", lambda x: x[chunk]), "")
    lines = F.transform(F.filter(F.split(body, "\n"), lambda t: F.startswith(t, F.lit("data: "))), lambda t: F.substr(t, F.lit(7)))
    events = whole.select(*key, F.transform(lines, lambda t: F.from_json(t, "type string, index int, delta struct<type:string,text:string,partial_json:string,stop_reason:string>")).alias("e"))
    joined = lambda kind, field: F.array_join(F.transform(F.filter("e", lambda x: x["delta"]["type"] == kind), lambda x: x["delta"][field]), "")
    stop = F.element_at(F.filter("e", lambda x: x["type"] == "message_delta"), -1)["delta"]["stop_reason"]
    return events.select(*key, joined("text_delta", "text").alias("text"), F.nullif(joined("input_json_delta", "partial_json"), F.lit("")).alias("input"), stop.alias("stop"))
