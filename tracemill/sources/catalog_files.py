"""Discover primitives: file layouts, configuration documents and session listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.consent import under_roots
from tracemill.sources import typed_json as J
from tracemill.sources.folders import list_folder

# Where a harness keeps its primitives below a base folder.
SKILL_FILE = r"\A(.*)/skills/([^/]+)/SKILL\.md\z"
DOCUMENT_FILE = r"\A(.*)/(agents|commands)/([^/]*)\.md\z"
PROJECT_FOLDER = "/.claude"
SETTINGS_FILE = "settings.json"
PROJECT_MCP_FILE = ".mcp.json"
PLUGIN_MANIFEST = "plugins/installed_plugins.json"


def list_documents(bases: DataFrame) -> DataFrame:
    """(path) of the files that may be primitives of ``bases(base)``: only their three
    folders are listed, and skill folders one level deeper; contents are not read."""
    base = bases.select("base").distinct()
    skills = base.select(F.concat("base", F.lit("/skills")).alias("path"))
    others = base.select(
        F.explode(F.array(*[F.concat("base", F.lit(f"/{d}")) for d in ("agents", "commands")])).alias("path")
    )
    inside = list_folder(list_folder(skills).where("is_folder"))
    return inside.unionByName(list_folder(others)).where("not is_folder").select("path")


def primitives_in_layout(paths: DataFrame, bases: DataFrame) -> DataFrame:
    """(base, kind, name) of the files that stand exactly where a primitive of a known base lives.

    ``bases(base)`` are the global folder, plugin install paths and project folders. The
    layout is matched by text, one level deep, then joined to the bases by equality.
    """
    path = F.col("path")
    skill_base = F.regexp_extract(path, SKILL_FILE, 1)
    document = F.regexp_extract(path, DOCUMENT_FILE, 2)
    is_skill = path.rlike(SKILL_FILE)
    is_document = path.rlike(DOCUMENT_FILE)
    located = paths.where(is_skill | is_document).select(
        F.when(is_skill, skill_base).otherwise(F.regexp_extract(path, DOCUMENT_FILE, 1)).alias("base"),
        F.when(is_skill, F.lit("skill"))
        .when(document == "agents", F.lit("subagent"))
        .otherwise(F.lit("command"))
        .alias("kind"),
        F.when(is_skill, F.regexp_extract(path, SKILL_FILE, 2))
        .otherwise(F.regexp_extract(path, DOCUMENT_FILE, 3))
        .alias("name"),
    )
    return located.join(bases.select("base").distinct(), "base", "left_semi")


def mcp_documents(home: DataFrame, plugins: DataFrame, projects: DataFrame) -> DataFrame:
    """(path) of every document that may name servers, below the given ``base`` folders."""
    return (
        home.select(F.concat("base", F.lit(f"/{SETTINGS_FILE}")).alias("path"))
        .unionByName(plugins.select(F.concat("base", F.lit(f"/{PROJECT_MCP_FILE}")).alias("path")))
        .unionByName(projects.select(F.concat("base", F.lit(f"/{PROJECT_MCP_FILE}")).alias("path")))
        .unionByName(projects.select(F.concat("base", F.lit(f"{PROJECT_FOLDER}/{SETTINGS_FILE}")).alias("path")))
    )


def mcp_servers(documents: DataFrame) -> DataFrame:
    """(kind, name) for the keys of ``mcpServers``; a malformed document contributes nothing."""
    doc = J.parse(F.col("value"))
    servers = F.try_variant_get(doc, f"{J.ROOT}.mcpServers", "map<string, variant>")
    return documents.select(F.explode(F.map_keys(servers)).alias("name")).select(
        F.lit("mcp_server").alias("kind"), "name"
    )


def plugin_paths(manifests: DataFrame) -> DataFrame:
    """Distinct install paths of the plugin manifests; a mistyped manifest yields none."""
    doc = J.parse(F.col("value"))
    path = f"{J.ROOT}.plugins"
    plugins = F.try_variant_get(doc, path, "map<string, variant>")
    versions = manifests.select("path", F.explode(F.map_values(plugins)).alias("versions"))
    listed = versions.select(
        "path",
        J.elements(F.col("versions"), "$").fits.alias("fits"),
        F.explode_outer(J.elements(F.col("versions"), "$").value).alias("plugin"),
    )
    install = J.string(F.col("plugin"), "$.installPath")
    checked = listed.select(
        "path",
        install.value.alias("base"),
        (
            F.col("fits")
            & (F.col("plugin").isNull() | (install.fits & J.object_fits(F.col("plugin"), "$")))
        ).alias("fits"),
    )
    broken = checked.where(~F.col("fits")).select("path").distinct()
    return (
        checked.join(broken, "path", "left_anti")
        .where(F.coalesce(F.col("base"), F.lit("")) != "")
        .select("base")
        .distinct()
    )


def may_announce(text: Column) -> Column:
    """Cheap text test: most transcript lines carry no attachment at all."""
    return text.contains("attachment")


# A line of a skill listing, ended by nothing but a newline, and the name in it.
SKILL_LINE = r"(?md)^- ([^\n]*?): "
# The members of an attachment that tell a listing.
ATTACHMENT = ("type", "content", "addedNames", "addedTypes")


def announced_names(cwd: Column, attachment: Column, given: Column) -> Column:
    """Array of (cwd, kind, name) that a line announces, from its members ``cwd`` and ``attachment`` and those in ``given``
    of the latter (``ATTACHMENT``); NULL for any other line.

    Skill listings are text, one ``- name: description`` per line; agents and servers come as arrays. A line that does
    not decode announces nothing. The cost follows the text: what is the same for all names of a line is read once.
    """
    where, label, content = (J.leaf(v, "STRING", "string") for v in (cwd, given["type"], given["content"]))
    names, types = J.strings(given["addedNames"]), J.strings(given["addedTypes"])
    fits = J.all_fit(where.fits, label.fits, content.fits, names.fits, types.fits, J.members_fit(attachment, given))
    skills = F.regexp_extract_all(content.value, F.lit(SKILL_LINE), F.lit(1))
    listing = F.struct(
        F.coalesce(where.value, F.lit("")).alias("cwd"),
        F.when(label.value == "skill_listing", "skill")
        .when(label.value == "agent_listing_delta", "subagent")
        .otherwise("mcp_server")
        .alias("kind"),
        F.when(label.value == "skill_listing", skills)
        .when(label.value == "agent_listing_delta", types.value)
        .when(label.value == "mcp_instructions_delta", names.value)
        .alias("names"),
    )
    # A lambda's variable is computed once, an expression inside it for every name.
    found = F.transform(F.array(listing), lambda one: F.transform(
        one["names"], lambda name: F.struct(one["cwd"].alias("cwd"), one["kind"].alias("kind"), name.alias("name"))))
    return F.when(fits, F.get(found, F.lit(0)))


def announced_primitives(announced: DataFrame, roots: DataFrame) -> DataFrame:
    """(kind, name) announced in working directories under ``roots(root)``; ``announced`` is (cwd, kind, name)."""
    # A listing repeats in every session: collapse before the root test and after it.
    return under_roots(announced.distinct(), roots).select("kind", "name").distinct()


def listed_primitives(lines: DataFrame, roots: DataFrame) -> DataFrame:
    """(kind, name) announced in session listings of working directories under ``roots(root)``.

    Reads framed lines (use the larger listing cap). An ingest that is asked to gives the same names from its one read.
    """
    text, line = F.col("value"), F.col("_line")
    read = lines.where(may_announce(text)).select("value", J.read(text, "cwd", "attachment").alias("_read"))
    opened = read.select(J.opened(text, F.col("_read")).alias("_doc")).select(F.col("_doc.root").alias("_line"))
    given = opened.select("_line", J.members(line["attachment"], *ATTACHMENT).alias("_given"))
    # The one-row generator keeps later filters from parsing a line again.
    names = announced_names(line["cwd"], line["attachment"], F.col("_given"))
    named = given.select(F.inline(F.array(F.struct(names.alias("announced")))))
    return announced_primitives(named.select(F.inline("announced")), roots)
