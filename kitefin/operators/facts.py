"""Call, use and points-to edges from tables of compiler facts.

functions(module, name, is_decl), instructions(module, func, seq, opcode), operands(module, func, seq, idx, kind,
target[, is_pointer]), initialisers(module, gv, kind, target), aliases(module, alias, kind, target), constants(module,
id, kind, target): `kind` is func, gv, alias, const or local, and a const's own operands are in constants. A local is the
result of the instruction of the same function whose seq is its target. Operand 0 of a call is what is called, its
arguments follow; a store has the value at 0 and the pointer at 1; a load has the pointer at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_intrinsic, virtual_init_name
from ..functions.text import c_type
from ..schema import GLOBAL_PREFIX
from ..shared import by_key, checkpoint
from .iterate import components, spread, spread_sets

CALLS = ("call", "invoke")
#: Operands of a store.
STORED, POINTER = 0, 1


def resolve(targets: DataFrame, constants: DataFrame, aliases: DataFrame) -> DataFrame:
    """targets (module, ..., kind, target) with nested constants and aliases replaced by the functions and globals in them."""
    inner = constants.select("module", F.col("id").alias("node"), "kind", "target").unionByName(aliases.select("module", F.col("alias").alias("node"), "kind", "target"))
    key = lambda m, n: F.concat_ws("\t", m, n)
    held = inner.select(key(F.col("module"), F.col("node")).alias("node"), "kind", "target", key(F.col("module"), F.col("target")).alias("inside"))
    nested = held.filter(F.col("kind").isin("const", "alias")).select(F.col("inside").alias("src"), F.col("node").alias("dst"))
    named = held.filter(F.col("kind").isin("func", "gv")).select("node", key(F.col("kind"), F.col("target")).alias("value"))
    leaves = spread(nested, named).select(F.col("node").alias("root"), F.substring_index("value", "\t", 1).alias("kind"), F.expr("substring(value, locate('\t', value) + 1)").alias("target"))
    plain = targets.filter(F.col("kind").isin("func", "gv"))
    rest = targets.filter(F.col("kind").isin("const", "alias")).withColumn("root", key(F.col("module"), F.col("target"))).drop("kind", "target").join(leaves, "root").drop("root")
    return plain.unionByName(rest.select(*plain.columns)).distinct()


def _with_opcode(operands: DataFrame, instructions: DataFrame) -> DataFrame:
    return operands.join(by_key(instructions.select("module", "func", "seq", "opcode")), ["module", "func", "seq"])


def call_edges(operands: DataFrame, instructions: DataFrame) -> DataFrame:
    """caller -> callee of direct calls, of functions stored, merged by phi or passed, and of calls whose result is loaded."""
    used = _with_opcode(operands, instructions)
    named = used.filter("kind = 'func'")
    taken = named.filter((F.col("opcode").isin(*CALLS, "phi") | (F.col("opcode") == "store") & (F.col("idx") == STORED)) & ~is_intrinsic(F.col("target")))
    return taken.select("module", F.col("func").alias("src"), F.col("target").alias("dst")).unionByName(loaded_calls(operands, instructions)).distinct()


def loaded_calls(operands: DataFrame, instructions: DataFrame) -> DataFrame:
    """module, src, dst: the function whose call gives the pointer of a load."""
    used = _with_opcode(operands, instructions)
    loads = used.filter("opcode = 'load' and idx = 0 and kind = 'local'").select("module", "func", F.col("target").alias("result"))
    calls = used.filter(F.col("opcode").isin(*CALLS) & (F.col("idx") == 0) & (F.col("kind") == "func") & ~is_intrinsic(F.col("target")))
    calls = calls.select("module", "func", F.col("seq").cast("string").alias("result"), F.col("target").alias("dst"))
    return loads.join(calls, ["module", "func", "result"]).select("module", F.col("func").alias("src"), "dst").distinct()


def used_functions(operands: DataFrame, constants: DataFrame, aliases: DataFrame, declared: DataFrame) -> DataFrame:
    """func, name, file: functions that a function's operands refer to, also inside constants and aliases, with their files;
    of a name that several files have, the least."""
    found = resolve(operands.select("module", "func", "kind", "target"), constants, aliases).filter("kind = 'func'").filter(~is_intrinsic(F.col("target")))
    return found.select("func", F.col("target").alias("name")).distinct().join(declared.groupBy("name").agg(F.min("file").alias("file")), "name", "left").select("func", "name", "file")


def used_globals(operands: DataFrame, constants: DataFrame, aliases: DataFrame, types: DataFrame) -> DataFrame:
    """func, name, c_type of the globals that a function's operands refer to. types: name, type (of the compiler; of several the
    least)."""
    found = resolve(operands.select("module", "func", "kind", "target"), constants, aliases).filter("kind = 'gv'").select("func", F.col("target").alias("name")).distinct()
    return found.join(types.groupBy("name").agg(F.min("type").alias("type")).select("name", c_type(F.col("type")).alias("c_type")), "name", "left").select("func", "name", "c_type")


def _value(kind: Column, target: Column) -> Column:
    """A name for a value of a module: locals belong to their function."""
    own = F.when(kind == "local", F.concat_ws("\t", F.col("module"), F.col("func"), kind, target))
    return F.coalesce(own, F.concat_ws("\t", F.col("module"), kind, target))


def _result() -> Column:
    return _value(F.lit("local"), F.col("seq").cast("string"))


def _valued(operands: DataFrame, instructions: DataFrame) -> DataFrame:
    """operands with opcode and value."""
    return _with_opcode(operands, instructions).withColumn("value", _value(F.col("kind"), F.col("target")))


def taken_functions(operands: DataFrame, instructions: DataFrame, constants: DataFrame, aliases: DataFrame) -> DataFrame:
    """module, src, value, func: addresses of functions that instructions take, the values that point at them, and in src
    the function around.

    A stored function is pointed at by the pointer; one that any other instruction but a call has among its operands, in
    constants and aliases too, but not through a global, by that instruction's result.
    """
    return _taken(_valued(operands, instructions), constants, aliases)


def _taken(used: DataFrame, constants: DataFrame, aliases: DataFrame) -> DataFrame:
    stored = used.filter((F.col("opcode") == "store") & (F.col("idx") == STORED) & (F.col("kind") == "func")).select("module", "func", "seq", "target", "value")
    into = used.filter((F.col("opcode") == "store") & (F.col("idx") == POINTER)).select("module", "func", "seq", F.col("value").alias("pointer"))
    by_store = stored.join(into, ["module", "func", "seq"]).select("module", F.col("func").alias("src"), F.explode(F.array("value", "pointer")).alias("value"), F.col("target").alias("func"))
    other = used.filter(~F.col("opcode").isin(*CALLS, "store")).withColumn("result", _result())
    reached = resolve(other.select("module", "func", "result", "kind", "target"), constants, aliases).filter("kind = 'func'")
    by_rest = reached.select("module", F.col("func").alias("src"), F.explode(F.array("result", F.concat_ws("\t", "module", "kind", "target"))).alias("value"), F.col("target").alias("func"))
    return by_store.unionByName(by_rest).distinct()


def copies(operands: DataFrame, instructions: DataFrame) -> DataFrame:
    """src, dst of values: what is stored goes to the pointer, and a call's result to its pointer arguments (is_pointer)."""
    return _copied(_valued(operands, instructions))


def _copied(used: DataFrame) -> DataFrame:
    value, into = (used.filter(f"opcode = 'store' and idx = {k}").select("module", "func", "seq", F.col("value").alias(n)) for k, n in ((STORED, "src"), (POINTER, "dst")))
    stores = value.join(into, ["module", "func", "seq"]).select("src", "dst")
    absorbed = used.filter(F.col("opcode").isin(*CALLS) & (F.col("idx") > 0) & F.col("is_pointer")).select(_result().alias("src"), F.col("value").alias("dst"))
    return stores.unionByName(absorbed).distinct()


def stored_global_edges(operands: DataFrame, instructions: DataFrame, aliases: DataFrame, pointing: DataFrame) -> DataFrame:
    """global -> function of stores into a global, or into an alias of one, of values that may point at functions."""
    return _stored_globals(_valued(operands, instructions), aliases, pointing)


def _stored_globals(used: DataFrame, aliases: DataFrame, pointing: DataFrame) -> DataFrame:
    return _global_stores(used, aliases).join(pointing.withColumnRenamed("func", "dst"), "value").select("src", "dst").distinct()


def _global_stores(used: DataFrame, aliases: DataFrame) -> DataFrame:
    """src, value: globals with the values stored into them or into aliases of them."""
    used = used.filter("opcode = 'store'")
    into = used.filter(F.col("idx") == POINTER).select("module", "func", "seq", "kind", "target")
    direct = into.filter("kind = 'gv'").select("module", "func", "seq", F.col("target").alias("gv"))
    through = into.filter("kind = 'alias'").join(aliases.filter("kind = 'gv'").select("module", F.col("alias").alias("target"), F.col("target").alias("gv")), ["module", "target"]).select("module", "func", "seq", "gv")
    stored = used.filter(F.col("idx") == STORED).select("module", "func", "seq", "value")
    held = direct.unionByName(through).join(stored, ["module", "func", "seq"])
    return held.select(F.concat(F.lit(GLOBAL_PREFIX), "gv").alias("src"), "value").distinct()


def program_edges(operands: DataFrame, instructions: DataFrame, constants: DataFrame, aliases: DataFrame) -> DataFrame:
    """src, dst of all that instructions imply: calls direct and through values, functions that arguments may point at
    from the callee, addresses taken, and stores into globals.

    Values that point at the same functions have one set (`spread_sets`): calls are paired as sets, each pair once, and
    written out as functions at the end.
    """
    every = checkpoint(_with_opcode(operands, instructions)).withColumn("value", _value(F.col("kind"), F.col("target")))
    taken = checkpoint(_taken(every, constants, aliases))
    # A result that no operand names neither goes anywhere nor is called, passed or stored.
    named = every.filter(F.col("opcode").isin(*CALLS, "store")).select(F.col("value").alias("node")).distinct()
    held = taken.select(F.col("value").alias("node"), F.col("func").alias("value")).distinct().join(by_key(named), "node", "left_semi")
    nodes, sets = spread_sets(_copied(every), held)
    at, functions = nodes.select(F.col("node").alias("value"), "set"), sets.select("set", F.col("value").alias("name"))
    used = every.filter(F.col("opcode").isin(*CALLS))
    called = used.filter("idx = 0").select("module", "func", "seq", "kind", "target", "value")
    known = called.filter("kind = 'func'").select("module", "func", "seq", F.concat(F.lit("func\t"), "target").alias("callee"))
    unknown = called.filter("kind <> 'func'").join(by_key(at), "value").select("module", "func", "seq", F.col("set").alias("callee"))
    callees = checkpoint(known.unionByName(unknown).distinct())
    passed = used.filter("idx > 0").select("module", "func", "seq", "value").join(by_key(at), "value").select("module", "func", "seq", F.col("set").alias("passed")).distinct()
    pairs = callees.join(by_key(passed), ["module", "func", "seq"]).select("callee", "passed").distinct()
    plain = callees.filter("callee LIKE 'func\t%'").select("callee", F.expr("substring(callee, 6)").alias("name")).distinct()
    names = checkpoint(plain.unionByName(functions.withColumnRenamed("set", "callee").join(by_key(callees.select("callee").distinct()), "callee", "left_semi")))
    arguments = pairs.join(by_key(functions.select(F.col("set").alias("passed"), F.col("name").alias("dst"))), "passed").select("callee", "dst").distinct()
    through = arguments.join(by_key(names), "callee").filter("name <> dst").select(F.col("name").alias("src"), "dst")
    calls = callees.select("func", "callee").distinct().join(by_key(names), "callee").select(F.col("func").alias("src"), F.col("name").alias("dst"))
    stored = _global_stores(every, aliases).join(by_key(at), "value").select("src", "set").distinct().join(by_key(functions), "set").select("src", F.col("name").alias("dst"))
    return calls.unionByName(through).unionByName(taken.select("src", F.col("func").alias("dst"))).unionByName(stored).distinct()


def initialiser_edges(initialisers: DataFrame, constants: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each module's pseudo-node -> every function that initialisers or aliases refer to."""
    found = resolve(initialisers.select("module", "kind", "target").unionByName(aliases.select("module", "kind", "target")), constants, aliases)
    return found.filter("kind = 'func'").select(virtual_init_name(F.col("module")).alias("src"), F.col("target").alias("dst")).distinct()


def global_edges(operands: DataFrame, initialisers: DataFrame, constants: DataFrame, aliases: DataFrame) -> DataFrame:
    """func -> global of uses, global -> global and global -> func of initialisers."""
    gv = lambda c: F.concat(F.lit(GLOBAL_PREFIX), c)
    uses = resolve(operands.select("module", "func", "kind", "target"), constants, aliases).filter("kind = 'gv'").select(F.col("func").alias("src"), gv(F.col("target")).alias("dst"))
    held = resolve(initialisers.select("module", "gv", "kind", "target"), constants, aliases)
    return uses.unionByName(held.select(gv(F.col("gv")).alias("src"), F.when(F.col("kind") == "gv", gv(F.col("target"))).otherwise(F.col("target")).alias("dst"))).distinct()


def points_to(copies: DataFrame, taken: DataFrame) -> DataFrame:
    """value, func: functions that values may point at, as a fix-point over copies (src value -> dst value).

    A single pass in instruction order finds a subset of this; the fix-point doesn't depend on any order.
    """
    return spread(copies, taken.select(F.col("value").alias("node"), F.col("func").alias("value"))).select(F.col("node").alias("value"), F.col("value").alias("func"))


def value_classes(operands: DataFrame, instructions: DataFrame, constants: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`unify` of a program's copies and taken functions; operands meet their instructions once."""
    every = checkpoint(_valued(operands, instructions))
    return unify(_copied(every), _taken(every, constants, aliases))


def unify(copies: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value, class) and (class, func): values that are copied into one another are one class, which points at all that its
    values do.

    A superset of `points_to` in two tables that are as long as the values and the functions taken, where `points_to` has a
    row for each pair. Classes are named by their least value.
    """
    copies = checkpoint(copies.select("src", "dst").distinct())
    held = checkpoint(taken.select("value", "func").distinct())
    values = copies.select(F.explode(F.array("src", "dst")).alias("name")).unionByName(held.select(F.col("value").alias("name"))).distinct()
    classes = checkpoint(components(copies, values).select(F.col("name").alias("value"), F.col("component").alias("class")))
    return classes, held.join(by_key(classes), "value").select("class", "func").distinct()


def indirect_edges(calls: DataFrame, arguments: DataFrame, pointing: DataFrame) -> DataFrame:
    """caller -> callee of calls (caller, value) through values, and callee -> function of arguments (caller, value, arg)."""
    at = pointing.select("value", F.col("func").alias("callee"))
    called = calls.join(at, "value").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    passed = arguments.join(at, "value").join(pointing.select(F.col("value").alias("arg"), F.col("func").alias("passed")), "arg").select(F.col("callee").alias("src"), F.col("passed").alias("dst"))
    return called.unionByName(passed).distinct()


def tagged(functions: DataFrame) -> DataFrame:
    """name@isDeclaration or name@isDefinition, without compiler intrinsics."""
    tag = F.when(F.col("is_decl"), "@isDeclaration").otherwise("@isDefinition")
    return functions.filter(~is_intrinsic(F.col("name"))).select("module", "name", F.concat("name", tag).alias("tagged"))


def adjacency_text(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """One line a function (module, text), those without callees too."""
    names = tagged(functions)
    ends = edges.join(names.select("module", F.col("name").alias("dst"), F.col("tagged").alias("callee")), ["module", "dst"])
    lists = ends.groupBy("module", "src").agg(F.concat_ws(" ", F.sort_array(F.collect_list("callee"))).alias("callees"))
    lists = lists.withColumnRenamed("src", "name")
    return names.join(lists, ["module", "name"], "left").select("module", F.concat("tagged", F.lit(" -> "), F.coalesce("callees", F.lit(""))).alias("text"))
