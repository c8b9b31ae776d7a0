"""Object identities and payloads as column expressions.

An object is `<kind> <length>\\0<payload>`, and its id is the digest of all that. Everything here is a built-in
expression, so hashing stays in generated code; no function of this module calls Python for a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six permissions of a tree entry as written, and the spellings that are read as the same.
PERMISSIONS = ("100644", "100755", "40000", "120000", "160000", "100664")
PERMISSION_ALIASES = {"44": "100644", "040000": "40000"}
#: Fixed value: the order of kinds when objects of different kinds are compared.
KIND_ORDER = {"tag": 0, "blob": 1, "tree": 2, "commit": 3}
#: The ids of the empty blob and the empty tree, and the digest of nothing, which stands for no object.
EMPTY_BLOB = "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
NULL_ID = "da39a3ee5e6b4b0d3255bfef95601890afd80709"



def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def header(kind: Column | str, size: Column) -> Column:
    """`<kind> <size>\\0` as BINARY."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(_bytes(F.concat_ws(" ", kind, size.cast("string"))), F.lit(b"\x00"))


def length_with_header(kind: Column | str, size: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return (F.octet_length(kind) + F.length(size.cast("string")) + 2 + size).cast("long")


def raw(kind: Column | str, payload: Column) -> Column:
    """Header and payload; payload is BINARY."""
    return F.concat(header(kind, F.octet_length(payload)), payload)


def object_id(kind: Column | str, payload: Column, algorithm: str = "sha1") -> Column:
    """Hex digest of an object; algorithm: sha1 or sha256."""
    whole = raw(kind, payload)
    return F.sha1(whole) if algorithm == "sha1" else F.sha2(whole, 256)


def blob_id(text: Column) -> Column:
    return object_id("blob", _bytes(text))


def link_id(target: Column) -> Column:
    """Id of a symbolic link: the blob of its target, with slashes either way as slashes."""
    return blob_id(F.translate(target, "\\", "/"))


def permission(written: Column) -> Column:
    """The permission that a tree entry's digits stand for, or null."""
    known = F.when(written.isin(*PERMISSIONS), written)
    for alias, meant in PERMISSION_ALIASES.items():
        known = F.when(written == alias, F.lit(meant)).otherwise(known)
    return known


def entry_key(perm: Column, name: Column) -> Column:
    """Sort key of tree entries: by bytes, directories as if their name ended with a slash."""
    return _bytes(F.concat(name, F.when(perm == "40000", F.lit("/")).otherwise(F.lit(""))))


def tree_entry(perm: Column, name: Column, node: Column) -> Column:
    """An entry as a tree's payload has it; node is a hex id."""
    return F.concat(_bytes(F.concat_ws(" ", perm, name)), F.lit(b"\x00"), F.unhex(node))


def tree_payload(perm: Column, name: Column, node: Column) -> Column:
    """Aggregate: the payload of the tree that the rows of a group make; node is a hex id."""
    part = F.concat(F.hex(_bytes(F.concat_ws(" ", perm, name))), F.lit("00"), F.upper(node))
    rows = F.array_sort(F.collect_list(F.struct(entry_key(perm, name).alias("k"), part.alias("p"))))
    return F.unhex(F.array_join(F.transform(rows, lambda r: r["p"]), ""))


def zone(sign: Column, hours: Column, minutes: Column) -> Column:
    """`±hhmm`; no offset (null) is written as +0000."""
    return F.coalesce(F.format_string("%s%02d%02d", sign, hours, minutes), F.lit("+0000"))


def user_line(name: Column, email: Column, ts: Column, tz: Column) -> Column:
    """`name <email> ts ±hhmm`."""
    return F.concat(name, F.lit(" <"), email, F.lit("> "), ts.cast("string"), F.lit(" "), tz)


USER = r"^(.*?) ?<([^>]*)> (-?[0-9]+) ([+-])([0-9]{2})([0-9]{2})$"


def parse_user(line: Column) -> Column:
    """STRUCT of name, email, ts and tz (minutes east; null for +0000 and -0000); null if the line is none."""
    part = lambda i: F.regexp_extract(line, USER, i)
    minutes = part(5).cast("int") * 60 + part(6).cast("int")
    tz = F.when(minutes != 0, F.when(part(4) == "-", -minutes).otherwise(minutes))
    return F.when(line.rlike(USER), F.struct(part(1).alias("name"), part(2).alias("email"), part(3).cast("long").alias("ts"), tz.alias("tz")))


def extra_value(lines: Column) -> Column:
    """Lines of an extra header's value, joined as continuation lines."""
    return F.array_join(lines, "\n ")


def commit_payload(tree: Column, parents: Column, author: Column, committer: Column, extra: Column, message: Column) -> Column:
    """The bytes of a commit. parents: array of ids; extra: array of struct<key, lines>; a null message leaves out the blank line."""
    head = F.concat(F.array(F.concat(F.lit("tree "), tree)), F.transform(parents, lambda p: F.concat(F.lit("parent "), p)))
    head = F.concat(head, F.array(F.concat(F.lit("author "), author), F.concat(F.lit("committer "), committer)))
    head = F.concat(head, F.transform(extra, lambda e: F.concat(e["key"], F.lit(" "), extra_value(e["lines"]))))
    body = F.when(message.isNull(), F.lit("")).otherwise(F.concat(F.lit("\n"), message))
    return _bytes(F.concat(F.array_join(head, "\n"), F.lit("\n"), body))


def parse_commit(payload: Column) -> Column:
    """STRUCT of tree, parents, author, committer, extra and message; null if it is no commit."""
    text = F.decode(payload, "UTF-8")
    whole = r"(?s)^tree ([0-9a-f]+)\n((?:parent [0-9a-f]+\n)*)author ([^\n]*)\ncommitter ([^\n]*)\n((?:[^\n]+\n)*)(?:\n(.*))?$"
    part = lambda i: F.regexp_extract(text, whole, i)
    parents = F.regexp_extract_all(part(2), F.lit("parent ([0-9a-f]+)"), F.lit(1))
    extras = F.filter(F.split(F.regexp_replace(part(5), r"\n$", ""), r"\n(?! )"), lambda x: x != "")
    extra = F.transform(extras, lambda x: F.struct(F.substring_index(x, " ", 1).alias("key"), F.split(F.regexp_replace(x, r"^[^ ]* ", ""), "\n ").alias("lines")))
    message = F.when(F.length(text) > F.length(F.regexp_extract(text, r"(?s)^((?:[^\n]+\n)*)", 1)), part(6))
    return F.when(text.rlike(whole), F.struct(part(1).alias("tree"), parents.alias("parents"), parse_user(part(3)).alias("author"), parse_user(part(4)).alias("committer"), extra.alias("extra"), message.alias("message")))


def tag_payload(obj: Column, kind: Column, tag: Column, tagger: Column, message: Column) -> Column:
    """The bytes of a tag; tagger and message may be null."""
    lines = F.array_compact(F.array(F.concat(F.lit("object "), obj), F.concat(F.lit("type "), kind), F.concat(F.lit("tag "), tag), F.concat(F.lit("tagger "), tagger)))
    body = F.when(message.isNull(), F.lit("")).otherwise(F.concat(F.lit("\n"), message))
    return _bytes(F.concat(F.array_join(lines, "\n"), F.lit("\n"), body))


def parse_tag(payload: Column) -> Column:
    """STRUCT of obj, kind, tag, tagger and message; null if it is no tag."""
    text = F.decode(payload, "UTF-8")
    whole = r"(?s)^object ([0-9a-f]+)\ntype ([a-z]+)\ntag ([^\n]*)\n(?:tagger ([^\n]*)\n)?(?:\n(.*))?$"
    part = lambda i: F.regexp_extract(text, whole, i)
    tagger = F.when(text.rlike(r"(?m)\A(?:[^\n]+\n)*?tagger "), parse_user(part(4)))
    message = F.when(text.rlike(r"(?s)\A(?:[^\n]+\n)+\n"), part(5))
    return F.when(text.rlike(whole), F.struct(part(1).alias("obj"), part(2).alias("kind"), part(3).alias("tag"), tagger.alias("tagger"), message.alias("message")))


def split_raw(whole: Column) -> Column:
    """STRUCT of kind, size and payload of header and payload together; null without a header or with another length."""
    head = F.decode(F.substring(whole, 1, 32), "ISO-8859-1")
    at = F.locate("\x00", head)
    kind, size = F.substring_index(head, " ", 1), F.regexp_extract(head, r"^[a-z]+ ([0-9]+)\x00", 1).cast("long")
    payload = F.substring(whole, at + 1, F.octet_length(whole))
    return F.when(kind.isin(*KIND_ORDER) & (size == F.octet_length(payload)), F.struct(kind.alias("kind"), size.alias("size"), payload.alias("payload")))


def short_id(oid: Column) -> Column:
    return F.substring(oid, 1, 8)


def id_byte(oid: Column, i: int) -> Column:
    """The i-th byte of an id."""
    return F.conv(F.substring(oid, 2 * i + 1, 2), 16, 10).cast("int")


def loose_path(oid: Column) -> Column:
    """Two digits, a slash, the rest."""
    return F.concat_ws("/", F.substring(oid, 1, 2), F.substring(oid, 3, 200))


def printable(text: Column) -> Column:
    """Control characters as dots."""
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", ".")
