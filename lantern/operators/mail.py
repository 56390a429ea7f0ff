"""Mail messages to edges, and labels of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lantern.graph import reindex, relabel

#: Logical lines behind the first three that may hold To, Cc and Bcc. One of these fields goes
#: on in the lines behind it that begin with a tab; any other line is a logical line.
HEADER_LINES = 20
FIRST = ("Message-ID:", "Date:", "From:")
STRIPPED = "'\" \t,"


def stripped(x: Column) -> Column:
    return F.btrim(x, F.lit(STRIPPED))


def parsed(messages: DataFrame) -> DataFrame:
    """(path, message_id, date, sender, recipients array<string>) of (path, text). The first
    three lines must be Message-ID, Date and From; To, Cc and Bcc follow within HEADER_LINES
    logical lines. Recipients are the distinct parts with an @ between commas, semicolons,
    spaces and angle brackets, without quotes around them. Messages whose first lines are
    others, or whose sender has a comma or semicolon, are left out."""
    whole = F.regexp_replace("text", "\r\n?", "\n")
    # A field's further lines are joined to it, from where the last match ended.
    whole = F.regexp_replace(whole, "(\n(?:To|Cc|Bcc):[^\n]*|\\G)\n\t([^\n]*)", "$1 $2")
    lines = F.split(whole, "\n")
    field = lambda i: F.btrim(F.substr(F.get("l", F.lit(i)), F.lit(len(FIRST[i]) + 1)), F.lit(" \t,"))
    fits = F.lit(True)
    for i, name in enumerate(FIRST):
        fits = fits & F.coalesce(F.get("l", F.lit(i)).startswith(name), F.lit(False))
    named = F.filter(F.slice("l", 4, HEADER_LINES), lambda x: x.rlike("^(To|Cc|Bcc):"))
    parts = F.flatten(F.transform(named, lambda x: F.split(F.regexp_replace(x, "^[A-Za-z]+:", ""), "[;,<> ]")))
    people = F.array_distinct(F.transform(F.filter(parts, lambda x: x.contains("@")), stripped))
    sides = F.filter(F.split("from", "[<>]"), lambda x: x.contains("@"))
    sender = stripped(F.when(F.size(sides) == 1, F.get(sides, F.lit(0))).otherwise(F.col("from")))
    # Exploded, as filters on a mere column would be moved before it and split each text again.
    m = messages.select("path", F.explode(F.array(lines)).alias("l")).filter(fits)
    m = m.select("path", field(0).alias("message_id"), field(1).alias("date"), field(2).alias("from"), people.alias("recipients"))
    return m.filter(~F.col("from").rlike("[,;]")).select("path", "message_id", "date", sender.alias("sender"), "recipients")


def repeated_ids(messages: DataFrame) -> DataFrame:
    """(message_id, n): ids that several of the parsed messages have; all of these count."""
    return messages.groupBy("message_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def valid(address: Column) -> Column:
    return address.rlike(r"^[^@]+@[^@]+\.[^@]+")


def edges(messages: DataFrame) -> DataFrame:
    """(source, target, n): messages from one valid address to another."""
    e = messages.select(F.col("sender").alias("source"), F.explode("recipients").alias("target"))
    return e.filter(valid(F.col("source")) & valid(F.col("target"))).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def domain(address: Column) -> Column:
    return F.substring_index(address, "@", -1)


def looks_automatic(address: Column, gateways: tuple[str, ...] = ()) -> Column:
    """Names that mix letters and digits or are mostly digits, and domains of automatic
    senders; gateways: parts of further such domains, in lower case."""
    end = domain(address)
    name = F.when(address.contains("@"), F.substr(address, F.lit(1), F.length(address) - F.length(end) - 1)).otherwise(address)
    n = F.length(name)
    letters, threes = (F.regexp_count(name, F.lit(x)) for x in ("[a-zÀ-ÿ]", "[a-zÀ-ÿ.]{3}"))
    mixed = (threes < F.bround(0.75 * (n / 3.0))) & (letters < 0.9 * n)
    automatic = mixed | (letters < 0.1 * n) | end.contains("newletter") | end.contains("postmaster")
    for g in gateways:
        automatic = automatic | F.lower(end).contains(g)
    return automatic


def kind(address: Column, inside: list[str], private: list[str], private_parts: list[str] = (), gateways: tuple[str, ...] = ()) -> Column:
    """bot, inside (a domain of `inside`), private (one of `private`, or one that has one of
    private_parts in it), university, government, or null."""
    d = domain(address)
    home = d.isin(list(private))
    for x in private_parts:
        home = home | d.contains(x)
    return (
        F.when(looks_automatic(address, gateways), "bot").when(d.isin(list(inside)), "inside").when(home, "private")
        .when(d.endswith(".edu"), "university").when(d.endswith(".gov"), "government")
    )


def simple_kind(address: Column, inside: list[str], gateways: tuple[str, ...] = ()) -> Column:
    return F.when(looks_automatic(address, gateways), "bot").when(domain(address).isin(list(inside)), "inside").otherwise("external")


def simple_role(role: Column, merged: dict[str, list[str]]) -> Column:
    """The group that has the role among its members, or the role itself."""
    out = role
    for name, members in merged.items():
        out = F.when(role.isin(members), name).otherwise(out)
    return out


def exclusive(df: DataFrame, *masks: Column) -> DataFrame:
    """One row, ok: whether no row of df is in two of the masks."""
    return df.agg((F.count_if(sum(m.cast("int") for m in masks) > 1) == 0).alias("ok"))


def described(nodes: DataFrame, roles: DataFrame, addresses: DataFrame) -> DataFrame:
    """nodes (id, ...) with role (id, role) and the domain of their address (id, address);
    'Unknown' where there is none."""
    d = addresses.select("id", domain(F.col("address")).alias("domain"))
    return nodes.join(roles.select("id", "role"), "id", "left").join(d, "id", "left").na.fill("Unknown", ["role", "domain"])


def dataset(messages: DataFrame, prefixes: DataFrame, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((src, dst, n), (index, role), (address, index)) of messages (path, text) and people
    (prefix, role) whose address is prefix@at: edges and roles by dense index of all addresses."""
    e = edges(parsed(messages))
    people = prefixes.select(F.concat("prefix", F.lit("@" + at)).alias("address"), "role")
    index = reindex(e.select(F.explode(F.array("source", "target")).alias("address")).unionByName(people.select("address")), "address")
    by = relabel(e.select(F.col("source").alias("src"), F.col("target").alias("dst"), "n"), index, "address")
    return by, people.join(index, "address").select("index", "role"), index


def within(e: DataFrame, members: DataFrame) -> DataFrame:
    """Edges whose ends are both members (id)."""
    one = lambda end: members.select(F.col("id").alias(end)).distinct()
    return e.join(one("src"), "src", "left_semi").join(one("dst"), "dst", "left_semi")
