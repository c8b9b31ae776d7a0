"""References, endpoints, capabilities and staging flags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD, MASTER, MAIN = "HEAD", "refs/heads/master", "refs/heads/main"


def clean_name(name: Column) -> Column:
    """A reference name with runs of slashes folded; null if it is empty, absolute or holds NUL."""
    good = (name != "") & ~F.startswith(name, F.lit("/")) & (F.instr(name, "\x00") == 0)
    return F.when(good, F.regexp_replace(name, "/+", "/"))


def segments(name: Column) -> Column:
    return F.split(name, "/")


def is_tag_name(name: Column) -> Column:
    return F.array_contains(segments(name), "tags")


def append(left: Column, right: Column) -> Column:
    """right below left; an absolute right side wins."""
    return F.when(F.startswith(right, F.lit("/")), right).otherwise(F.regexp_replace(F.concat_ws("/", left, right), "/+", "/"))


def parse_contents(text: Column) -> Column:
    """STRUCT of oid and ref of a reference's file: an id, or two fields of which the second is a name; one of them is null."""
    bare = F.trim(F.regexp_replace(text, r"[\r\n]+$", ""))
    fields = F.filter(F.split(bare, r"[\s:]+"), lambda x: x != "")
    is_id = bare.rlike("^[0-9a-f]{40}$")
    return F.when(is_id, F.struct(bare.alias("oid"), F.lit(None).cast("string").alias("ref"))).when(
        F.size(fields) == 2, F.struct(F.lit(None).cast("string").alias("oid"), F.get(fields, 1).alias("ref"))
    )


def write_contents(oid: Column, ref: Column) -> Column:
    return F.when(oid.isNotNull(), F.concat(oid, F.lit("\n"))).otherwise(F.concat(F.lit("ref: "), ref, F.lit("\n")))


def parse_endpoint(url: Column) -> Column:
    """STRUCT of scheme, user, password, host, port and path of `user@host:path` or `scheme://[user[:password]@]host[:port]/path`."""
    full = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^:@/]*)(?::([^@/]*))?@)?([^:/]+)(?::([0-9]+))?(/.*)?$"
    scp = r"^([^@/:]+)@([^:/]+):(.*)$"
    part = lambda p, i: F.nullif(F.regexp_extract(url, p, i), F.lit(""))
    none = F.lit(None).cast("string")
    return F.when(
        url.rlike(full),
        F.struct(F.lower(part(full, 1)).alias("scheme"), part(full, 2).alias("user"), part(full, 3).alias("password"), part(full, 4).alias("host"), part(full, 5).cast("int").alias("port"), F.coalesce(part(full, 6), F.lit("/")).alias("path")),
    ).when(
        url.rlike(scp),
        F.struct(F.lit("ssh").alias("scheme"), part(scp, 1).alias("user"), none.alias("password"), part(scp, 2).alias("host"), none.cast("int").alias("port"), F.coalesce(part(scp, 3), F.lit("/")).alias("path")),
    )


def print_endpoint(e: Column) -> Column:
    """The text of what parse_endpoint() gives, in its full form, without the password; null without a host."""
    user = F.coalesce(F.concat(e["user"], F.lit("@")), F.lit(""))
    port = F.coalesce(F.concat(F.lit(":"), e["port"].cast("string")), F.lit(""))
    path = F.when(F.startswith(e["path"], F.lit("/")), e["path"]).otherwise(F.concat(F.lit("/"), e["path"]))
    return F.concat(e["scheme"], F.lit("://"), user, e["host"], port, path)


def basic_auth(user: Column, password: Column) -> Column:
    """The Authorization header's value, or null without a user."""
    return F.when(user.isNotNull(), F.concat(F.lit("Basic "), F.base64(F.encode(F.concat_ws(":", user, F.coalesce(password, F.lit(""))), "UTF-8"))))


def capabilities(text: Column) -> Column:
    """Array of struct<name, value>; value is null for those without."""
    each = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    value = lambda x: F.when(F.instr(x, "=") > 0, F.substring(x, F.instr(x, "=") + 1, F.length(x)))
    return F.transform(each, lambda x: F.struct(F.substring_index(x, "=", 1).alias("name"), value(x).alias("value")))


def shared_capabilities(ours: Column, theirs: Column) -> Column:
    """Names that both sides have, sorted."""
    names = lambda c: F.transform(capabilities(c), lambda x: x["name"])
    return F.array_sort(F.array_intersect(names(ours), names(theirs)))


def ack_level(shared: Column) -> Column:
    """How acknowledgements are sent, from the shared capabilities."""
    return F.when(F.array_contains(shared, "multi_ack_detailed"), "detailed").when(F.array_contains(shared, "multi_ack"), "multi").otherwise("none")


def no_done(shared: Column, stateless: bool = False) -> Column:
    """Whether the other side may send without a final done: if both know no-done, and without a connection in any case."""
    return F.lit(True) if stateless else F.array_contains(shared, "no-done")


def stage(flags: Column) -> Column:
    return F.shiftright(flags.bitwiseAND(F.lit(0x3000)), 12)


def flag(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


SKIP_WORKTREE, INTENT_TO_ADD = 0x4000, 0x2000
ASSUME_VALID, EXTENDED = 0x8000, 0x4000
STAGES, NAME_LENGTH = 0x3000, 0xFFF


def entry_mode(kind: Column, executable: Column) -> Column:
    """Mode of a staged entry: links 120000, directories of another repository 160000, files 100755 or 100644 (octal)."""
    octal = lambda s: F.lit(int(s, 8))
    return F.when(kind == "link", octal("120000")).when(kind == "module", octal("160000")).when(executable, octal("100755")).otherwise(octal("100644"))
