"""SQL statements of a change log: what they are and what becomes of them, as column expressions on their tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexer
from .lexer import NAME, NESTED, QUALIFIED, name_of

_BY = r"(or\s+replace\s+)?(algorithm\s*=\s*\S+\s+)?(definer\s*=\s*\S+\s+(@\s+\S+\s+)?)?(sql\s+security\s+\S+\s+)?"
#: Tried in this order; the first that fits names the statement.
CLASSES = [
    ("DDL", "CREATE_TABLE", r"create\s+((global|local)\s+)?((temporary|temp|unlogged)\s+)?table\b"), ("DDL", "ALTER_TABLE", r"alter\s+(ignore\s+)?table\b"), ("DDL", "DROP_TABLE", r"drop\s+(temporary\s+)?tables?\b"),
    ("DDL", "TRUNCATE_TABLE", r"truncate\b"), ("DDL", "RENAME_TABLE", r"rename\s+tables?\b"), ("DDL", "CREATE_INDEX", r"create\s+((unique|fulltext|spatial)\s+)?index\b"),
    ("DDL", "DROP_INDEX", r"drop\s+index\b"), ("DDL", "CREATE_DATABASE", r"create\s+(database|schema)\b"), ("DDL", "ALTER_DATABASE", r"alter\s+(database|schema)\b"),
    ("DDL", "DROP_DATABASE", r"drop\s+(database|schema)\b"),
    ("DDL", "CREATE_ROUTINE", rf"create\s+{_BY}(aggregate\s+)?(procedure|function)\b"), ("DDL", "CREATE_TRIGGER", rf"create\s+{_BY}trigger\b"),
    ("DDL", "CREATE_EVENT", rf"create\s+{_BY}event\b"), ("DDL", "CREATE_VIEW", rf"create\s+{_BY}(materialized\s+)?view\b"),
    ("DDL", "DROP_OTHER", r"drop\s+(materialized\s+)?(view|procedure|function|trigger|event|user|role)\b"), ("DDL", "ALTER_OTHER", rf"alter\s+{_BY}(view|procedure|function|event|user)\b"), ("DDL", "ACCOUNT", r"(grant|revoke|create\s+(user|role)|rename\s+user)\b"),
    ("DML", "INSERT", r"insert\b"), ("DML", "UPDATE", r"update\b"), ("DML", "DELETE", r"delete\b"), ("DML", "REPLACE", r"replace\b"),
    ("TRANSACTION", "BEGIN", r"(begin|start\s+transaction)\b"), ("TRANSACTION", "COMMIT", r"commit\b"), ("TRANSACTION", "ROLLBACK", r"rollback\b"), ("TRANSACTION", "SAVEPOINT", r"(savepoint|release\s+savepoint)\b"), ("TRANSACTION", "XA", r"xa\b"),
    ("USE", "USE", r"use\b"),
]

_EXISTS = r"(?:if (?:not )?exists )?"
_MADE_BY = r"(?:or replace )?(?:algorithm = \S+ )?(?:definer = \S+ (?:@ \S+ )?)?(?:sql security \S+ )?"
#: Shapes whose two groups are the database and the table of a statement; the first that fits decides.
_TABLES = [
    rf"(?:create|alter|drop|rename|lock|analyze|optimize) (?:or replace )?(?:(?:global|local|temporary|temp|unlogged|ignore) )*tables? {_EXISTS}(?:only )?{QUALIFIED}",
    rf"truncate (?:table )?(?:only )?{QUALIFIED}",
    rf"create (?:(?:unique|fulltext|spatial) )?index (?:concurrently )?{_EXISTS}(?:(?!on )[^\s(),;.'=]+ )?(?:using \S+ )?on (?:only )?{QUALIFIED}",
    rf"drop index {_EXISTS}[^\s(),;.'=]+ on {QUALIFIED}",
    rf"(?:create|alter|drop) {_MADE_BY}(?:materialized |aggregate )?(?:view|procedure|function|event) {_EXISTS}{QUALIFIED}",
    rf"create {_MADE_BY}trigger {_EXISTS}(?:[^\s(),;.'=]+ \. )?[^\s(),;.'=]+ (?:before|after) \S+ on {QUALIFIED}",
    rf"(?:insert|replace) (?:(?:low_priority|delayed|high_priority|ignore|overwrite) )*(?:into )?{QUALIFIED}",
    rf"update (?:(?:low_priority|ignore|only) )*{QUALIFIED}",
    rf"delete (?:(?:low_priority|quick|ignore) )*from (?:only )?{QUALIFIED}",
]
#: Shapes that name a database alone, in their one group.
_DATABASES = [rf"(?:create|alter|drop) (?:database|schema) {_EXISTS}{NAME}", rf"drop trigger {_EXISTS}{NAME} \. ", rf"drop index (?:concurrently )?{_EXISTS}{NAME} \. "]


def bare(sql: Column) -> Column:
    """Without leading comments and white space."""
    return F.regexp_replace(sql, r"^(\s+|/\*(?!!)[\s\S]*?\*/|--[^\n]*(\n|$)|#[^\n]*(\n|$))+", "")


def classify(sql: Column) -> tuple[Column, Column]:
    """Class and kind of a statement; OTHER where nothing fits. ``USE db;`` before a statement doesn't count."""

    def of(s: Column) -> Column:
        kind, sub = F.lit("OTHER"), F.lit("OTHER")
        for a, b, pattern in reversed(CLASSES):
            fits = s["shape"].rlike(rf"(?i)^{pattern}")
            kind, sub = F.when(fits, F.lit(a)).otherwise(kind), F.when(fits, F.lit(b)).otherwise(sub)
        return F.struct(kind.alias("kind"), sub.alias("sub"))

    found = lexer.let(lexer.scanned(sql), of)
    return found["kind"], found["sub"]


def _table(s: Column) -> Column:
    """db and name of a scanned statement; the database of a USE before it where the statement names none."""
    parts = F.array(F.lit(""), F.lit("")).cast("array<string>")
    for pattern in reversed(_DATABASES):
        parts = F.when(s["shape"].rlike(f"(?i)^{pattern}"), F.array(F.regexp_extract(s["shape"], f"(?i)^{pattern}", 1), F.lit(""))).otherwise(parts)
    for pattern in reversed(_TABLES):
        parts = F.when(s["shape"].rlike(f"(?i)^{pattern}"), F.array(*[F.regexp_extract(s["shape"], f"(?i)^{pattern}", i) for i in (1, 2)])).otherwise(parts)
    named = lambda n: F.struct(F.when((n[0] == "") & (n[1] != ""), s["use_db"]).otherwise(n[0]).alias("db"), n[1].alias("name"))
    return lexer.let(F.transform(parts, lambda p: name_of(p, s["toks"])), named)


def table_of(sql: Column) -> tuple[Column, Column]:
    """Database (empty where none is named) and table that a statement is about; of a view or routine its name, of an index its table."""
    found = lexer.let(lexer.scanned(sql), _table)
    return found["db"], found["name"]


def affected_tables(sql: Column, database: Column) -> Column:
    """``db.table`` of each table whose columns a statement may change, in the order it names them; others none.

    All tables of a DROP and both names of each RENAME; names without a database are of ``database``.
    """

    def of(s: Column) -> Column:
        one, of_list = rf"(?i)^(?:create|alter) (?:(?:global|local|temporary|temp|unlogged|ignore) )*table {_EXISTS}(?:only )?({QUALIFIED})", rf"(?i)^(?:drop (?:temporary )?tables?|rename tables?|truncate(?: table)?) {_EXISTS}(.*)$"
        single = F.regexp_extract(s["shape"], one, 1)
        several = F.regexp_replace(F.regexp_extract(s["shape"], of_list, 1), r"(?i) (?:cascade|restrict)$", "")
        several = F.split(several, r"(?i) , | to ")
        named = F.when(single != "", F.array(single)).when(s["shape"].rlike(of_list), several).otherwise(F.array().cast("array<string>"))

        def full(x: Column) -> Column:
            db, name = (name_of(F.regexp_extract(x, f"^{QUALIFIED}$", i), s["toks"]) for i in (1, 2))
            return F.concat(F.when(db != "", db).when(s["use_db"] != "", s["use_db"]).otherwise(database), F.lit("."), name)

        return F.array_compact(F.transform(named, full))

    return lexer.let(lexer.scanned(sql), of)


_VALUE = r"('\d+'|(?:- )?\d+)"
_INTO = rf"(?i)^(?:insert|replace) (?:(?:low_priority|delayed|high_priority|ignore) )*(?:into )?{QUALIFIED}"


def _plain_value(part: Column, toks: Column) -> Column:
    """A key's value as one text however it is written: quotes, signs, case and leading zeros don't count; null where it isn't plain."""
    text = lexer.let(part, lambda p: F.when(p.rlike(r"^'\d+'$"), F.lower(F.rtrim(lexer.literal_text(lexer.said(p, toks))))).when(p.rlike(r"^(- )?\d+$"), F.replace(p, F.lit(" "), F.lit(""))))
    return lexer.let(text, lambda t: F.when(t.rlike(r"^[+-]?\d+$"), F.regexp_replace(F.regexp_replace(t, r"^\+?(-?)0+(?=\d)", "$1"), r"^(\+|-(?=0$))", "")).otherwise(t))


def conflict_key(sql: Column, pk: str = "id", keys: dict[str, str] | None = None) -> Column:
    """``db.table:value`` of a data statement that touches one row by its key, ``db.table:*`` of any other that has a table.

    ``*`` alone, which meets every key, is a data statement of several tables or of none that can be read; empty is what has
    no table at all. ``keys`` names the key columns of tables where they aren't ``pk``. One row it is where an INSERT has a
    single row with a plain value for the key, or where the key equals a plain value in a WHERE that joins its conditions
    by AND, and the key isn't assigned.
    """

    named = F.create_map(*[F.lit(x) for k, v in (keys or {"": ""}).items() for x in (k.lower(), v.lower())])
    rows = rf"{_INTO} \( ([^()]*) \) values? \(((?:[^()]++|{NESTED})*+)\)(?: as \S+)?$"
    equal = rf"^(?:[^\s(),;.'=]+ \. )*{NAME} = {_VALUE}$"

    def of(s: Column) -> Column:
        toks, shape = s["toks"], s["shape"]
        open_ = F.regexp_replace(shape, rf"\( ((?:[^\s(),;'=]+ \. )*[^\s(),;.'=]+ = {_VALUE}) \)", "$1")
        return lexer.let(F.struct(toks.alias("toks"), shape.alias("shape"), _table(s).alias("table"), lexer.flat(open_).alias("plain"), lexer.whole(toks, shape).alias("whole")), by_table)

    def by_table(s: Column) -> Column:
        toks, shape, plain, name, db = s["toks"], s["shape"], s["plain"], s["table"]["name"], s["table"]["db"]
        key = F.coalesce(F.element_at(named, F.lower(name)), F.lit(pk.lower())) if keys else F.lit(pk.lower())
        is_key = lambda part: F.lower(name_of(part, toks)) == key
        among = lambda conds: F.get(F.transform(F.filter(conds, lambda c: c.rlike(equal) & is_key(F.regexp_extract(c, equal, 1))), lambda c: F.regexp_extract(c, equal, 2)), F.lit(0))
        # INSERT: the value at the key's place of the only row, or of a SET list.
        of_row = lambda columns, values: F.when(F.size(columns) == F.size(values), F.get(values, (F.array_position(F.transform(columns, lambda c: F.lower(name_of(F.trim(c), toks))), key) - 1).cast("int")))
        inserted = F.when(shape.rlike(rows), lexer.let(F.struct(F.split(F.regexp_extract(shape, rows, 3), " , ").alias("c"), lexer.items(F.regexp_extract(shape, rows, 4)).alias("v")), lambda x: of_row(x["c"], x["v"])))
        of_set = among(lexer.items(F.regexp_extract(shape, rf"{_INTO} set ((?:(?! on duplicate ).)*)$", 3)))
        # UPDATE and DELETE: a condition of its own on the key, which isn't assigned.
        where = F.regexp_extract(plain, r"(?i) where (.+?)(?: order by .*| limit .*| returning .*)?$", 1)
        assigned = F.split(F.regexp_extract(plain, r"(?i)^update .*? set (.+?)(?: where .*)?$", 1), " , ")
        moved = F.exists(assigned, lambda a: is_key(F.regexp_extract(a, rf"(?:[^\s(),;'=]+ \. )*{NAME} = .*", 1)))
        met = F.when(~moved, lexer.let(where, lambda w: F.when(~w.rlike(r"(?i)(^|\s)(or|xor|between|case|not|\|\||!)(\s|$)"), among(F.split(w, "(?i) (?:and|&&) ")))))
        head = F.regexp_replace(plain, r"(?i) where .*$", "")
        several = plain.rlike(r"(?i)^update (?:(?! set ).)*(?: , | join )") | head.rlike(r"(?i)^delete .*(?: , | join | using )") | head.rlike(r"(?i)^delete (?:(?:low_priority|quick|ignore) )*+(?!from )")
        found = F.when(shape.rlike(r"(?i)^(insert|replace)\b"), F.coalesce(inserted, of_set)).when(shape.rlike(r"(?i)^(update|delete)\b"), met)
        value = F.when(s["whole"], _plain_value(F.coalesce(found, F.lit("")), toks))
        none = (name == "") & ~shape.rlike(r"(?i)^(insert|replace|update|delete|with)\b")
        every = shape.rlike(r"(?i)^(insert|replace|update|delete|with)\b") & ((name == "") | several)
        return F.when(every, F.lit("*")).when(none, F.lit("")).otherwise(F.concat(F.when(db == "", name).otherwise(F.concat(db, F.lit("."), name)), F.lit(":"), F.coalesce(value, F.lit("*"))))

    return lexer.let(lexer.scanned(sql), of)


SHADOW = r"(?i)^_(.+)_(?:gho|new|ghost_)$"
_HELPER = r"(?i)^_.+_(?:gho|new|ghost_|ghc|del|old)$"


def online_change(sql: Column) -> Column:
    """What becomes of a statement of an online schema tool.

    ALTER: the CREATE of a shadow table, which is to become an ALTER of the table it shadows (``lists.shadow_change``); SKIP:
    any other statement on a shadow or helper table, and a RENAME that puts one in place; PASS: all others.
    """

    def of(s: Column) -> Column:
        name = _table(s)["name"]
        renames = s["shape"].rlike("(?i)^rename tables? ") & F.exists(F.split(F.regexp_replace(s["shape"], "(?i)^rename tables? ", ""), r"(?i) , | to "), lambda x: name_of(F.regexp_extract(x, f"{QUALIFIED}$", 2), s["toks"]).rlike(_HELPER))
        return F.when(s["shape"].rlike("(?i)^create table ") & name.rlike(SHADOW), F.lit("ALTER")).when(name.rlike(_HELPER) | renames, F.lit("SKIP")).otherwise(F.lit("PASS"))

    return lexer.let(lexer.scanned(sql), of)


def ddl_decision(kind: Column, sub: Column, policy: str, in_scope: Column) -> Column:
    """APPLY, SKIP or MANUAL for a schema statement: outside the scope never, triggers and events later by hand."""
    by_policy = {"AUTO_APPLY": "APPLY", "SKIP": "SKIP", "MANUAL": "MANUAL"}[policy]
    return (
        F.when(kind != "DDL", F.lit("NONE")).when(~in_scope, F.lit("SKIP"))
        .when(sub.isin("CREATE_TRIGGER", "CREATE_EVENT"), F.lit("DEFER")).when(sub == "DROP_DATABASE", F.lit("MANUAL")).otherwise(F.lit(by_policy))
    )
