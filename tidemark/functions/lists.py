"""Lists within text: rows of SQL values, array literals, redo statements and column definitions, cut at their own commas.

Parentheses and braces may stand 12 levels deep; what is deeper, doesn't close or doesn't fit its columns is not read: it
stays as the text it was, for a person.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexer
from .lexer import NAME, NESTED, QUALIFIED, name_of

_CALL = rf"^\S+ {NESTED}$"


def value_of(part: Column, toks: Column, escapes: bool = True) -> Column:
    """A value of a list: literals as their text, NULL as null, a call with a literal first as that (dates, hex), numbers and all else as written."""

    def of(p: Column) -> Column:
        literal = F.when(p.rlike(r"^'\d+'$"), p).when(p.rlike(r"^[nNeE] '\d+'$"), F.substring(p, 3, 40)).when(p.rlike(_CALL), F.nullif(F.regexp_extract(p, r"^\S+ \( ('\d+')", 1), F.lit("")))
        written = F.regexp_replace(lexer.text_of(p, toks), r"^([+-]) (?=\d)", "$1")
        text = lexer.let(literal, lambda x: F.when(x.isNotNull(), lexer.literal_text(lexer.said(x, toks), escapes)).otherwise(written))
        return F.when(F.upper(p).isin("NULL", "DEFAULT", ""), F.lit(None).cast("string")).when(p.rlike(r"(?i)^empty_[cb]lob \( \)$"), F.lit("")).otherwise(text)

    return lexer.let(part, of)


def row_values(text: Column, escapes: bool = True) -> Column:
    """Values of one row, ``1, 'a,b', NULL`` with or without its parentheses, as an array of text; null where it doesn't close."""

    def of(s: Column) -> Column:
        inner = F.when(s["shape"].rlike(rf"^{NESTED}$"), F.regexp_extract(s["shape"], r"^\( ?(.*?) ?\)$", 1)).otherwise(s["shape"])
        return F.when(lexer.whole(s["toks"], s["shape"]), F.transform(lexer.items(inner), lambda v: value_of(v, s["toks"], escapes)))

    return lexer.let(lexer.scanned(text, escapes), of)


def row_image(text: Column, columns: Column, escapes: bool = True) -> Column:
    """image (column to value) and raw of a row of values: where their number isn't the columns', image is null and raw the text."""

    def of(values: Column) -> Column:
        fits = values.isNotNull() & (F.size(values) == F.size(columns))
        return F.struct(F.when(fits, F.map_from_arrays(columns, values)).alias("image"), F.when(~F.coalesce(fits, F.lit(False)), text).alias("raw"))

    return lexer.let(row_values(text, escapes), of)


def typed_row(image: Column, types: dict[str, str]) -> Column:
    """An image as a struct of the named types; what isn't of its type is null."""
    return F.struct(*[F.element_at(image, c).try_cast(t).alias(c) for c, t in types.items()])


_QUOTED = r'"(?:[^"\\]++|\\[\s\S])*+"'


def _braces(depth: int = 12) -> str:
    inside = rf'(?:[^{{}}"]++|{_QUOTED})*+'
    for _ in range(depth):
        inside = rf'(?:[^{{}}"]++|{_QUOTED}|\{{{inside}\}})*+'
    return rf"\{{{inside}\}}"


_BRACES = _braces()
_ELEMENT = rf'\s*+({_QUOTED}|{_BRACES}|[^,{{}}"]++)\s*+'


def array_values(text: Column, kind: str = "string") -> Column:
    """Elements of an array literal ``{1,NULL,"a,b"}`` as an array of ``kind``; inner arrays stay literals; null where it isn't one."""
    inner = F.regexp_extract(text, r"^\s*(?:\[[\d:\]\[]*\]=)?\{([\s\S]*)\}\s*$", 1)
    found = F.regexp_extract_all(F.concat(inner, F.lit(",")), F.lit(rf"{_ELEMENT},"), F.lit(1))

    def element(x: Column) -> Column:
        plain = F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), r"\\([\s\S])", "$1")
        return F.when(x.startswith('"'), plain).when(F.upper(F.trim(x)) == "NULL", F.lit(None).cast("string")).otherwise(F.trim(x)).try_cast(kind)

    good = text.rlike(rf"^\s*+(?:\[[\d:\]\[]*\]=)?\{{(?:\s*+|{_ELEMENT}(?:,{_ELEMENT})*+)\}}\s*+$")
    return F.when(text.rlike(r"^\s*\{\s*\}\s*$"), F.array().cast(f"array<{kind}>")).when(good, F.transform(found, element))


def redo_change(sql: Column) -> Column:
    """op, db, name, before, after and raw of a redo statement, as a log miner prints it.

    INSERT gives after, DELETE before from its conditions, UPDATE both: after is before with what it sets. ROWID conditions
    don't count. Where a statement doesn't have that form, op is null and raw the text.
    """

    def of(s: Column) -> Column:
        toks, shape = s["toks"], s["shape"]
        value = lambda v: value_of(F.trim(v), toks, escapes=False)
        name = lambda n: name_of(F.trim(n), toks)
        insert, update, delete = rf"(?i)^insert into {QUALIFIED} \( ([^()]*) \) values \(((?:[^()]++|{NESTED})*+)\)$", rf"(?i)^update {QUALIFIED}(?: \S+)? set (.+?)(?: where (.+))?$", rf"(?i)^delete from {QUALIFIED}(?: where (.+))?$"
        part = lambda p, i: F.regexp_extract(shape, p, i)
        pair = rf"(?i)^(?:[^\s(),;.'=]+ \. )*{NAME} (?:= |(is ))(.*)$"
        pairs = lambda xs: F.transform(F.filter(xs, lambda x: x.rlike(pair) & (F.upper(F.regexp_extract(x, pair, 1)) != "ROWID")), lambda x: F.struct(name(F.regexp_extract(x, pair, 1)).alias("k"), value(F.regexp_extract(x, pair, 3)).alias("v")))
        image = lambda found: lexer.let(found, lambda ps: F.map_from_entries(F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, F.lit(1), i), lambda q: q["k"] == p["k"]))))
        conditions = lambda text: F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"^\( (.*) \)$", "$1"), "(?i) and "))
        columns, values = F.transform(F.split(part(insert, 3), " , "), name), F.transform(lexer.items(part(insert, 4)), value)
        row = lambda op, p, before, after: F.struct(F.lit(op).alias("op"), name_of(part(p, 1), toks).alias("db"), name_of(part(p, 2), toks).alias("name"), before.alias("before"), after.alias("after"), F.lit(None).cast("string").alias("raw"))
        none, text = F.lit(None).cast("map<string,string>"), F.lit(None).cast("string")
        whole = lexer.whole(toks, shape)
        put = lambda found, changed: F.map_concat(F.map_filter(found, lambda k, v: ~F.array_contains(F.map_keys(changed), k)), changed)
        updated = lexer.let(F.struct(image(pairs(conditions(part(update, 4)))).alias("b"), image(pairs(lexer.items(part(update, 3)))).alias("c")), lambda x: row("u", update, x["b"], put(x["b"], x["c"])))
        inserted = lexer.let(F.struct(columns.alias("c"), values.alias("v")), lambda x: F.when(F.size(x["c"]) == F.size(x["v"]), row("c", insert, none, F.map_from_arrays(x["c"], x["v"]))))
        unread = F.struct(text.alias("op"), text.alias("db"), text.alias("name"), none.alias("before"), none.alias("after"), sql.alias("raw"))
        return (
            F.when(whole & shape.rlike(insert), F.coalesce(inserted, unread)).when(whole & shape.rlike(update), updated).when(whole & shape.rlike(delete), row("d", delete, image(pairs(conditions(part(delete, 3)))), none))
            .otherwise(unread)
        )

    return lexer.let(lexer.scanned(sql, escapes=False), of)


_CREATE = rf"(?i)^create (?:(?:global|local|temporary|temp|unlogged) )*table (?:if not exists )?{QUALIFIED} \(((?:[^()]++|{NESTED})*+)\)"
_NO_COLUMN = r"(?i)^(?:primary|unique|key|index|constraint|foreign|fulltext|spatial|check|exclude|like|period)\b"


def _definitions(s: Column) -> Column:
    """name, key (lower case), column and text of each definition of a scanned CREATE TABLE, in order."""

    def one(x: Column) -> Column:
        is_column = ~x.rlike(_NO_COLUMN)
        named = F.when(is_column, F.regexp_extract(x, rf"^{NAME}", 1)).otherwise(F.regexp_extract(x, rf"(?i)^(?:(?:unique|fulltext|spatial) )?(?:constraint|key|index) {NAME}", 1))
        rest = F.when(is_column, F.regexp_replace(x, r"^\S+ ?", "")).otherwise(x)
        return F.struct(name_of(named, s["toks"]).alias("name"), F.lower(name_of(named, s["toks"])).alias("key"), is_column.alias("column"), lexer.text_of(rest, s["toks"]).alias("text"), x.alias("shape"))

    return F.transform(F.filter(lexer.items(F.regexp_extract(s["shape"], _CREATE, 3)), lambda x: x != ""), one)


def created_columns(sql: Column) -> Column:
    """Names of the columns of a CREATE TABLE, in order."""
    return lexer.let(lexer.scanned(sql), lambda s: F.transform(F.filter(_definitions(s), lambda d: d["column"]), lambda d: d["name"]))


def column_changes(sql: Column) -> Column:
    """What a schema statement does to the columns of its table, in order: op, name, to and after.

    create and add (name; after a name, "" for the first place, null for the last), drop, rename (to), move (after), and gone for
    DROP TABLE. Statements and parts that leave the columns as they are do nothing.
    """

    def of(s: Column) -> Column:
        toks, shape = s["toks"], s["shape"]
        text = F.lit(None).cast("string")
        change = lambda op, name=text, to=text, after=text: F.struct(F.lit(op).alias("op"), name.alias("name"), to.alias("to"), after.alias("after"))
        name = lambda x: name_of(x, toks)
        _ALTER = rf"(?i)^alter (?:ignore )?table (?:if exists )?(?:only )?{QUALIFIED} (.*)$"
        parts = lexer.items(F.regexp_extract(shape, _ALTER, 3))
        place = lambda x: F.when(x.rlike("(?i) first$"), F.lit("")).when(x.rlike(rf"(?i) after {NAME}$"), name(F.regexp_extract(x, rf"(?i) after {NAME}$", 1)))
        if_ = "(?:if (?:not )?exists )?"
        add, add_list, drop = rf"(?i)^add (?:column )?{if_}{NAME} ", rf"(?i)^add (?:column )?\(((?:[^()]++|{NESTED})*+)\)$", rf"(?i)^drop (?:column )?{if_}{NAME}(?: cascade| restrict)?$"
        rename, changed, moved = rf"(?i)^rename column {NAME} to {NAME}$", rf"(?i)^change (?:column )?{NAME} {NAME} ", rf"(?i)^modify (?:column )?{NAME} "
        no_column = r"(?i)^(?:add|drop) (?:primary|unique|key|index|constraint|foreign|fulltext|spatial|check|partition)\b"

        def of_part(x: Column) -> Column:
            at = lambda p, i=1: name(F.regexp_extract(x, p, i))
            nothing = F.filter(F.array(change("add")), lambda c: F.lit(False))
            moves = lambda n: F.when(place(x).isNotNull(), F.array(change("move", n, text, place(x)))).otherwise(nothing)
            several = F.transform(F.filter(lexer.items(F.regexp_extract(x, add_list, 1)), lambda d: ~d.rlike(_NO_COLUMN)), lambda d: change("add", name(F.regexp_extract(d, rf"^{NAME}", 1))))
            renamed_table = r"(?i)^rename (?:to |as )?(?!column |index |key )[^\s(),;'=]+( \. [^\s(),;'=]+)?$"
            return (
                F.when(x.rlike(renamed_table), F.array(change("gone"))).when(x.rlike(no_column), nothing).when(x.rlike(add_list), several).when(x.rlike(add), F.array(change("add", at(add), text, place(x)))).when(x.rlike(drop), F.array(change("drop", at(drop))))
                .when(x.rlike(rename), F.array(change("rename", at(rename), at(rename, 2)))).when(x.rlike(changed), F.concat(F.array(change("rename", at(changed), at(changed, 2))), moves(at(changed, 2)))).when(x.rlike(moved), moves(at(moved))).otherwise(nothing)
            )

        of_create = F.transform(F.filter(_definitions(s), lambda d: d["column"]), lambda d: change("create", d["name"]))
        return F.when(shape.rlike(_CREATE), of_create).when(shape.rlike("(?i)^drop (?:temporary )?tables? "), F.array(change("gone"))).otherwise(F.flatten(F.transform(parts, of_part)))

    return lexer.let(lexer.scanned(sql), of)


def shadow_change(shadow: Column, original: Column, table: Column) -> Column:
    """The ALTER TABLE of ``table`` that gives it the columns and keys of its shadow table; null where nothing changes.

    ``shadow`` and ``original`` are both tables' CREATE statements. A column that stands in another's place with the same
    definition is that column renamed. A key without a name that is no longer there leaves no statement either: null.
    """
    kept = lambda defs, others: F.filter(defs, lambda d: F.exists(others, lambda o: o["key"] == d["key"]))
    new = lambda defs, others: F.filter(defs, lambda d: ~F.exists(others, lambda o: o["key"] == d["key"]))
    columns = lambda defs: F.filter(defs, lambda d: d["column"])
    keys = lambda defs: F.filter(defs, lambda d: ~d["column"])
    quoted = lambda n: F.concat(F.lit("`"), F.replace(n, F.lit("`"), F.lit("``")), F.lit("`"))
    squeezed = lambda t: F.lower(F.regexp_replace(t, r"\s+", ""))

    def of(p: Column) -> Column:
        sc, oc, sk, ok = p["sc"], p["oc"], p["sk"], p["ok"]
        at = lambda defs, key: F.array_position(F.transform(defs, lambda d: d["key"]), key)
        # A new column where one is gone, with its definition: renamed.
        was = lambda d: F.get(F.filter(new(oc, sc), lambda x: (at(oc, x["key"]) == at(sc, d["key"])) & (squeezed(x["text"]) == squeezed(d["text"]))), F.lit(0))
        is_renamed = lambda d: was(d).isNotNull()
        added = F.filter(new(sc, oc), lambda d: ~is_renamed(d))
        renamed = F.filter(new(sc, oc), is_renamed)
        before = lambda d: F.get(sc, (at(sc, d["key"]) - 2).cast("int"))
        place = lambda d: F.when(at(sc, d["key"]) == F.size(sc), "").when(at(sc, d["key"]) == 1, " FIRST").otherwise(F.concat(F.lit(" AFTER "), quoted(before(d)["name"])))
        gone = F.filter(new(oc, sc), lambda x: ~F.exists(renamed, lambda d: was(d)["key"] == x["key"]))
        other = F.filter(kept(sc, oc), lambda d: ~F.exists(oc, lambda x: (x["key"] == d["key"]) & (squeezed(x["text"]) == squeezed(d["text"]))))
        lost = F.filter(ok, lambda d: ~F.exists(sk, lambda x: squeezed(x["text"]) == squeezed(d["text"])))
        fresh = F.filter(sk, lambda d: ~F.exists(ok, lambda x: squeezed(x["text"]) == squeezed(d["text"])))
        primary = lambda d: d["shape"].rlike("(?i)^(constraint \\S+ )?primary key")
        drop_key = lambda d: F.when(primary(d), F.lit("DROP PRIMARY KEY")).when(d["name"] == "", F.lit(None).cast("string")).when(d["shape"].rlike("(?i)foreign key"), F.concat(F.lit("DROP FOREIGN KEY "), quoted(d["name"]))).when(d["shape"].rlike("(?i) check "), F.concat(F.lit("DROP CHECK "), quoted(d["name"]))).otherwise(F.concat(F.lit("DROP KEY "), quoted(d["name"])))
        steps = F.concat(
            F.transform(lost, drop_key), F.transform(renamed, lambda d: F.concat(F.lit("RENAME COLUMN "), quoted(was(d)["name"]), F.lit(" TO "), quoted(d["name"]))),
            F.transform(gone, lambda d: F.concat(F.lit("DROP COLUMN "), quoted(d["name"]))), F.transform(other, lambda d: F.concat(F.lit("MODIFY COLUMN "), quoted(d["name"]), F.lit(" "), d["text"])),
            F.transform(added, lambda d: F.concat(F.lit("ADD COLUMN "), quoted(d["name"]), F.lit(" "), d["text"], place(d))), F.transform(fresh, lambda d: F.concat(F.lit("ADD "), d["text"])),
        )
        said = lambda st: F.when((F.size(sc) > 0) & (F.size(oc) > 0) & (F.size(st) > 0) & ~F.exists(st, lambda x: x.isNull()), F.concat(F.lit("ALTER TABLE "), table, F.lit(" "), F.array_join(st, ", ")))
        return lexer.let(steps, said)

    parted = lambda p: F.struct(columns(p["s"]).alias("sc"), columns(p["o"]).alias("oc"), keys(p["s"]).alias("sk"), keys(p["o"]).alias("ok"))
    return lexer.let(lexer.let(F.struct(lexer.let(lexer.scanned(shadow), _definitions).alias("s"), lexer.let(lexer.scanned(original), _definitions).alias("o")), parted), of)
