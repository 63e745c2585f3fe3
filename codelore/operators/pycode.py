"""Static analysis of Python files and name resolution across a repository.

Parsing is per file and spread over all tasks (``analyse``).  Resolution needs a repository's
symbol table, so it runs per repository (``resolve``); a repository is one task.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codelore.operators.chunking import parse

#: Distinct names in the readable list of a symbol's calls; edges come from all call sites.
MOST_CALLS = 40
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Wrappers of an annotation that leave the class it names as it is.
WRAPPERS = ("Optional", "ClassVar", "Final")
#: Outside bases without members of their own, and those that make a protocol.
PROTOCOLS = ("typing.Protocol", "typing_extensions.Protocol")
TRANSPARENT = ("typing.Generic", *PROTOCOLS, "abc.ABC")


def _chain(node: ast.AST) -> list[str] | None:
    """The names of an attribute chain such as a.b.c."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    match node:
        case ast.Name(id=first):
            return [first, *reversed(names)]
        case ast.Call(func=ast.Name(id="super")):
            return ["super()", *reversed(names)]
    return None


def _calls(body: list[ast.stmt]) -> tuple[list[tuple[str, int]], list[str]]:
    """(all call sites by line, the first ``MOST_CALLS`` distinct names)."""
    found = []
    for statement in body:
        for node in ast.walk(statement):
            if isinstance(node, ast.Call) and (names := _chain(node.func)):
                found.append((".".join(names), node.lineno))
    return sorted(found, key=lambda x: x[1]), list(dict.fromkeys(name for name, _ in found))[:MOST_CALLS]


def _type(node: ast.AST | None) -> str | None:
    """The one class that an annotation names, or that a value is made by; None otherwise."""
    match node:
        case ast.Call():
            return ".".join(names) if (names := _chain(node.func)) else None
        case ast.Constant(value=str(text)):
            try:
                return _type(ast.parse(text, mode="eval").body)
            except (SyntaxError, ValueError):
                return None
        case ast.Subscript(value=wrapper, slice=inner):
            return _type(inner) if (names := _chain(wrapper)) and names[-1] in WRAPPERS else None
        case ast.BinOp(op=ast.BitOr(), left=left, right=ast.Constant(value=None)) | ast.BinOp(op=ast.BitOr(), left=ast.Constant(value=None), right=left):
            return _type(left)
        case ast.Name() | ast.Attribute():
            return ".".join(names) if (names := _chain(node)) else None
    return None


class _Names:
    """Types that are stated for names; a name with one stated type and no other binding has it."""

    def __init__(self) -> None:
        self.types: dict[str, set[str | None]] = {}

    def bind(self, name: str | None, kind: str | None = None) -> None:
        if name:
            self.types.setdefault(name, set()).add(kind)

    def value(self, name: str, value: ast.AST) -> None:
        """``name = value``; None says nothing about the type, and only a call states one."""
        if isinstance(value, ast.Constant) and value.value is None:
            self.types.setdefault(name, set())
        else:
            self.bind(name, _type(value) if isinstance(value, ast.Call) else None)

    def agreed(self) -> dict[str, str]:
        return {name: next(iter(kinds)) for name, kinds in self.types.items() if len(kinds) == 1 and None not in kinds}


def _attribute_of(target: ast.AST, owner: str) -> str | None:
    match target:
        case ast.Attribute(value=ast.Name(id=name), attr=attribute) if owner and name == owner:
            return attribute
    return None


def _scan(function: ast.FunctionDef | ast.AsyncFunctionDef, owner: str, attributes: _Names) -> tuple[dict[str, str], list[str]]:
    """(types of local names, all names bound in the function); types of ``owner``'s attributes go
    to ``attributes``.  Names of nested functions count as the function's own.
    """
    local, shared, placed = _Names(), set(), set()

    def arguments(given: ast.arguments) -> None:
        for argument in [*given.posonlyargs, *given.args, *given.kwonlyargs]:
            local.bind(argument.arg, _type(argument.annotation))
        for argument in (given.vararg, given.kwarg):
            local.bind(argument.arg if argument else None)

    arguments(function.args)
    for node in (n for statement in function.body for n in ast.walk(statement)):
        match node:
            case ast.Assign(targets=targets, value=value):
                for target in targets:
                    if isinstance(target, ast.Name):
                        placed.add(target)
                        local.value(target.id, value)
                    elif attribute := _attribute_of(target, owner):
                        attributes.value(attribute, value)
            case ast.AnnAssign(target=target, annotation=annotation):
                if isinstance(target, ast.Name):
                    placed.add(target)
                    local.bind(target.id, _type(annotation))
                elif attribute := _attribute_of(target, owner):
                    attributes.bind(attribute, _type(annotation))
            case ast.AugAssign(target=target) if attribute := _attribute_of(target, owner):
                attributes.bind(attribute)
            case ast.Global(names=names):
                shared.update(names)
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                local.bind(node.name)
                arguments(node.args)
            case ast.Lambda():
                arguments(node.args)
            case ast.ClassDef(name=name) | ast.ExceptHandler(name=name) | ast.MatchAs(name=name) | ast.MatchStar(name=name) | ast.MatchMapping(rest=name):
                local.bind(name)
            case ast.Name(id=name, ctx=ast.Store() | ast.Del()) if node not in placed:
                local.bind(name)
    kinds = {name: kind for name, kind in local.agreed().items() if name not in shared}
    return kinds, sorted(local.types.keys() - shared)


class Analysis(NamedTuple):
    """A file's symbols and imports, whether it does not parse, the names assigned at its top
    level, and what ``__all__`` lists (None without one; nothing if it is computed).
    """

    symbols: list[dict]
    imports: list[dict]
    failed: bool
    assigned: list[str]
    exports: list[str] | None


def _top_names(body: list[ast.stmt]) -> tuple[list[str], list[str] | None]:
    """Names that statements outside of definitions bind, and the exports."""
    assigned: set[str] = set()
    exports: list[str] | None = None
    computed = False
    queue: list[ast.AST] = list(body)
    for node in queue:
        if isinstance(node, (ast.ClassDef, ast.Lambda, *_FUNCTIONS)):
            continue
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, (ast.AnnAssign, ast.AugAssign)) else []
        if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and node.value is not None:
            if isinstance(node.value, (ast.List, ast.Tuple)) and all(isinstance(e, ast.Constant) and isinstance(e.value, str) for e in node.value.elts):
                listed = [e.value for e in node.value.elts]
                exports = [*exports, *listed] if isinstance(node, ast.AugAssign) and exports is not None else listed
            else:
                computed = True
        if isinstance(node, ast.Name) and not isinstance(node.ctx, ast.Load):
            assigned.add(node.id)
        elif isinstance(node, ast.ExceptHandler) and node.name:
            assigned.add(node.name)
        queue.extend(ast.iter_child_nodes(node))
    return sorted(assigned), [] if computed else exports


def analyse_source(source: str) -> Analysis:
    """What one file defines; nested functions belong to the outer one."""
    tree = parse(source)
    if tree is None:
        return Analysis([], [], True, [], None)
    symbols, imports = [], []

    def walk(body: list[ast.stmt], parent: str, attributes: _Names) -> None:
        for node in body:
            name = f"{parent}.{node.name}" if parent and hasattr(node, "name") else getattr(node, "name", "")
            if isinstance(node, ast.ClassDef):
                bases = [".".join(c) for b in node.bases if (c := _chain(b.value if isinstance(b, ast.Subscript) else b))]
                symbol = {"name": name, "kind": "class", "parent": parent, "start_line": node.lineno, "end_line": node.end_lineno, "bases": bases, "calls": [], "called": [], "locals": {}, "bound": [], "owner": "", "of_class": False, "is_async": False}
                symbols.append(symbol)
                own = _Names()
                walk(node.body, name, own)
                symbol["locals"] = own.agreed()
            elif isinstance(node, _FUNCTIONS):
                marks = {".".join(c) for d in node.decorator_list if (c := _chain(d))}
                first = [*node.args.posonlyargs, *node.args.args]
                owner = first[0].arg if parent and first and "staticmethod" not in marks else ""
                kinds, bound = _scan(node, owner, attributes)
                sites, called = _calls(node.body)
                symbols.append(
                    {"name": name, "kind": "method" if parent else "function", "parent": parent, "start_line": node.lineno, "end_line": node.end_lineno, "bases": [], "calls": [{"chain": c, "line": n} for c, n in sites], "called": called,
                     "locals": kinds, "bound": bound, "owner": owner, "of_class": bool(parent) and "classmethod" in marks, "is_async": isinstance(node, ast.AsyncFunctionDef)}
                )
            elif parent and isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
                attributes.bind(node.target.id, _type(node.annotation))
            elif parent and isinstance(node, ast.Assign):
                for target in node.targets:
                    if isinstance(target, ast.Name):
                        attributes.value(target.id, node.value)

    walk(tree.body, "", _Names())
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [{"module": a.name, "name": "", "alias": a.asname or a.name.split(".")[0], "level": 0, "line": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports += [{"module": node.module or "", "name": a.name, "alias": a.asname or a.name, "level": node.level, "line": node.lineno} for a in node.names]
    return Analysis(symbols, imports, False, *_top_names(tree.body))


SYMBOL = "struct<name:string,kind:string,parent:string,start_line:long,end_line:long,bases:array<string>,calls:array<struct<chain:string,line:long>>,called:array<string>,locals:map<string,string>,bound:array<string>,owner:string,of_class:boolean,is_async:boolean>"
IMPORT = "struct<module:string,name:string,alias:string,level:long,line:long>"
_SYMBOL = pa.struct([("name", pa.string()), ("kind", pa.string()), ("parent", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("bases", pa.list_(pa.string())), ("calls", pa.list_(pa.struct([("chain", pa.string()), ("line", pa.int64())]))), ("called", pa.list_(pa.string())), ("locals", pa.map_(pa.string(), pa.string())), ("bound", pa.list_(pa.string())), ("owner", pa.string()), ("of_class", pa.bool_()), ("is_async", pa.bool_())])
_IMPORT = pa.struct([("module", pa.string()), ("name", pa.string()), ("alias", pa.string()), ("level", pa.int64()), ("line", pa.int64())])


def analyse(files: DataFrame) -> DataFrame:
    """(repository, path, symbols, imports, failed, assigned, exports) of Python files (repository,
    path, content).
    """
    names = pa.list_(pa.string())
    schema = pa.schema([("repository", pa.string()), ("path", pa.string()), ("symbols", pa.list_(_SYMBOL)), ("imports", pa.list_(_IMPORT)), ("failed", pa.bool_()), ("assigned", names), ("exports", names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [analyse_source(c or "") for c in b.column(2).to_pylist()]
            symbols = [[{**s, "locals": list(s["locals"].items())} for s in x.symbols] for x in found]
            columns = [symbols, *([x[i] for x in found] for i in range(1, 5))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.string()), *(pa.array(c, schema.field(i + 2).type) for i, c in enumerate(columns))], schema=schema)

    return files.select("repository", "path", "content").mapInArrow(run, f"repository string, path string, symbols array<{SYMBOL}>, imports array<{IMPORT}>, failed boolean, assigned array<string>, exports array<string>")


class Repository:
    """The symbol table of one repository and the resolution of names in it."""

    def __init__(self, files: list[dict]):
        self.files = {f["path"]: f for f in files}
        self.dotted: dict[str, list[str]] = {}
        for path in sorted(self.files):
            name = path[:-3].replace("/", ".")
            name = name[: -len(".__init__")] if name.endswith(".__init__") else name
            parts = name.split(".")
            for i in range(len(parts)):
                self.dotted.setdefault(".".join(parts[i:]), []).append(path)
            self.files[path]["dotted"] = name
        self.symbols = {(p, s["name"]): s for p, f in self.files.items() for s in f["symbols"]}
        self._orders: dict[tuple[str, str], list[tuple[str, str]]] = {}
        self._own_names: dict[str, set[str]] = {}
        self.bindings = {p: self._bind(p) for p in self.files}

    def module(self, dotted: str, importer: str, level: int = 0) -> str | None:
        """The file of a module: relative by level, else nearest shared root, else a unique suffix."""
        own = self.files[importer]["dotted"].split(".")
        if level:
            package = own if importer.endswith("/__init__.py") or importer == "__init__.py" else own[:-1]
            base = package[: len(package) - level + 1]
            wanted = ".".join([*base, *([dotted] if dotted else [])])
            return next((p for p in self.dotted.get(wanted, []) if self.files[p]["dotted"] == wanted), None)
        for depth in range(len(own) - 1, -1, -1):
            wanted = ".".join([*own[:depth], dotted])
            for path in self.dotted.get(wanted, []):
                if self.files[path]["dotted"] == wanted:
                    return path
        found = self.dotted.get(dotted, []) if "." in dotted else []
        return found[0] if len(found) == 1 else None

    def _explicit(self, path: str) -> set[str]:
        """Names that a file binds itself, without those of ``import *``."""
        if path in self._own_names:
            return self._own_names[path]
        f = self.files[path]
        self._own_names[path] = {s["name"] for s in f["symbols"] if "." not in s["name"]} | set(f.get("assigned") or ()) | {i["alias"] for i in f["imports"] if i["name"] != "*"}
        return self._own_names[path]

    def _bind(self, path: str) -> dict[str, tuple | None]:
        """Names of a file: ('symbol', path, name), ('module', path, ''), ('package', dotted, ''),
        ('external', dotted, ''); None for a name that is assigned, or bound in several ways.
        """
        out: dict[str, set[tuple]] = {}
        add = lambda name, *value: out.setdefault(name, set()).add(value)
        for s in self.files[path]["symbols"]:
            if "." not in s["name"]:
                add(s["name"], "symbol", path, s["name"])
        for name in self.files[path].get("assigned") or ():
            add(name, "assigned", path, name)
        for i in self.files[path]["imports"]:
            module, name, alias = i["module"], i["name"], i["alias"]
            if name == "*":
                continue
            if name:
                dotted = f"{module}.{name}" if module else name
                home, sub = self.module(module, path, i["level"]), self.module(dotted, path, i["level"])
                if sub and not (home and name in self._explicit(home)):
                    add(alias, "module", sub, "")
                elif home:
                    add(alias, "symbol", home, name)
                else:
                    add(alias, "external", dotted, "")
                continue
            whole, head = self.module(module, path), self.module(module.split(".")[0], path)
            if alias != module.split(".")[0]:  # import a.b as c
                add(alias, *(("module", whole, "") if whole else ("external", module, "")))
            elif "." not in module or head:
                add(alias, *(("module", head, "") if head else ("external", module, "")))
            else:
                add(alias, *(("package", module.split(".")[0], "") if whole else ("external", module.split(".")[0], "")))
        return {name: next(iter(values)) if len(values) == 1 and not any(v[0] == "assigned" for v in values) else None for name, values in out.items()}

    def _read(self, path: str, i: dict) -> str | None:
        """The file that an import statement of one name reads."""
        home = self.module(i["module"], path, i["level"])
        if i["name"] in ("", "*"):
            return home
        sub = self.module(f"{i['module']}.{i['name']}" if i["module"] else i["name"], path, i["level"])
        return sub if sub and not (home and i["name"] in self._explicit(home)) else home

    def _starred(self, path: str, name: str) -> Iterator[str]:
        """Files whose ``import *`` in ``path`` gives it ``name``, the last one first."""
        for i in reversed(self.files[path]["imports"]):
            if i["name"] == "*" and (home := self.module(i["module"], path, i["level"])):
                exports = self.files[home].get("exports")
                if name in exports if exports is not None else not name.startswith("_"):
                    yield home

    def lookup(self, path: str, name: str, seen: frozenset = frozenset()) -> tuple[str, str] | None:
        """The defining (path, symbol) of a name in a file, through re-exports and ``import *``."""
        if (path, name) in seen:
            return None
        seen = seen | {(path, name)}
        if name in self.bindings.get(path, {}):
            bound = self.bindings[path][name]
            if bound is None or bound[0] != "symbol":
                return None
            return (path, name) if (bound[1], bound[2]) == (path, name) else self.lookup(bound[1], bound[2], seen)
        if path not in self.files:
            return None
        return next((at for home in self._starred(path, name) if (at := self.lookup(home, name, seen))), None)

    def resolve_chain(self, path: str, chain: list[str]) -> tuple[str, str] | None:
        """The symbol of a dotted chain that starts at a name bound in the file."""
        head, *rest = chain
        bound = self.bindings[path].get(head)
        if bound is None:
            at = None if head in self.bindings[path] else self.lookup(path, head)
            return self._member(at, rest) if at and rest else at
        if bound[0] == "external":
            return None
        if bound[0] == "package":
            for n in range(len(chain) - 1, 0, -1):
                if home := self.module(".".join(chain[:n]), path):
                    return self._inside(home, chain[n:])
            return None
        if bound[0] == "module":
            return self._inside(bound[1], rest) if rest else None
        at = self.lookup(bound[1], bound[2])
        return self._member(at, rest) if at and rest else at

    def _inside(self, path: str, names: list[str]) -> tuple[str, str] | None:
        """What dotted names mean inside a module: its own names first, then a submodule's."""
        if not names:
            return None
        bound = self.bindings.get(path, {}).get(names[0])
        if bound and bound[0] == "module":
            return self._inside(bound[1], names[1:])
        if at := self.lookup(path, names[0]):
            return self._member(at, names[1:]) if names[1:] else at
        if names[0] not in self.bindings.get(path, {}) and path.rsplit("/", 1)[-1] == "__init__.py":
            dotted = f"{self.files[path]['dotted']}.{names[0]}"
            if sub := next((p for p in self.dotted.get(dotted, []) if self.files[p]["dotted"] == dotted), None):
                return self._inside(sub, names[1:])
        return None

    def _base(self, cls: tuple[str, str], base: str) -> tuple[str, str] | None:
        """The class that a base names; ('', dotted) if it is outside, None if that adds no member."""
        found = self.resolve_chain(cls[0], base.split("."))
        if found and found != cls and self.symbols[found]["kind"] == "class":
            return found
        dotted = self._outside(cls[0], base)
        return None if dotted in TRANSPARENT or (base == "object" and base not in self.bindings[cls[0]]) else ("", dotted)

    def _outside(self, path: str, name: str) -> str:
        """A dotted name with the module that its head was imported from."""
        head, _, rest = name.partition(".")
        bound = self.bindings[path].get(head)
        return f"{bound[1]}.{rest}".rstrip(".") if bound and bound[0] == "external" else name

    def _is_protocol(self, cls: tuple[str, str]) -> bool:
        return any(self._outside(cls[0], base) in PROTOCOLS for base in self.symbols[cls]["bases"])

    def mro(self, cls: tuple[str, str], seen: frozenset = frozenset()) -> list[tuple[str, str]] | None:
        """C3 order of a class; None if there is none.  ('', dotted) stands for an outside base."""
        if cls not in self.symbols:
            return [cls]
        if cls in self._orders:
            return self._orders[cls]
        if cls in seen:
            return None
        parents = [p for base in self.symbols[cls]["bases"] if (p := self._base(cls, base))]
        above = [self.mro(p, seen | {cls}) for p in parents]
        if any(q is None for q in above):
            return None
        queues, out = [*above, parents], [cls]
        while queues := [q for q in queues if q]:
            head = next((q[0] for q in queues if not any(q[0] in r[1:] for r in queues)), None)
            if head is None:
                return None
            out.append(head)
            queues = [q[1:] if q[0] == head else q for q in queues]
        self._orders[cls] = out
        return out

    def _member(self, cls: tuple[str, str], names: list[str], skip_self: bool = False) -> tuple[str, str] | None:
        if len(names) != 1:
            return None
        for c in (self.mro(cls) or [])[int(skip_self) :]:
            if c not in self.symbols:
                return None  # an outside base may define it
            if (c[0], f"{c[1]}.{names[0]}") in self.symbols:
                return c[0], f"{c[1]}.{names[0]}"
        return None

    def edges(self, only: set[str] | None = None) -> list[tuple[str, str, str, str, int]]:
        """(kind, source, target, via, line) of imports, inheritance and calls of the files in ``only``.

        An import's ``via`` is the name that the statement reads, or its module.
        """
        out = []
        for path, f in self.files.items():
            if only is not None and path not in only:
                continue
            for i in sorted(f["imports"], key=lambda i: i["line"]):
                home = self._read(path, i)
                if home and home != path:
                    out.append(("IMPORTS", path, home, i["name"] or i["module"], i["line"]))
            for s in f["symbols"]:
                source = f"{path}::{s['name']}"
                for base in s["bases"]:
                    at = self._base((path, s["name"]), base)
                    if at in self.symbols:
                        protocol = self._is_protocol(at) and not self._is_protocol((path, s["name"]))
                        out.append(("IMPLEMENTS" if protocol else "INHERITS", source, f"{at[0]}::{at[1]}", "", s["start_line"]))
                for call in s["calls"]:
                    at, via = self._call(path, s, call["chain"].split("."))
                    if at and f"{at[0]}::{at[1]}" != source:
                        out.append(("CALLS", source, f"{at[0]}::{at[1]}", via, call["line"]))
        return out

    def outside(self, only: set[str] | None = None) -> list[tuple[str, str, str, int]]:
        """(kind, path, package, line) of statements that read no other file of the repository:
        ``EXTERNAL`` with the top-level package, or ``UNRESOLVED`` if they are relative.
        """
        out = []
        for path, f in self.files.items():
            if only is not None and path not in only:
                continue
            statements: dict[tuple, list[dict]] = {}
            for n, i in enumerate(f["imports"]):
                # ``import a, b`` is a statement for each; names of one ``from`` share theirs.
                statements.setdefault((i["line"], i["module"], i["level"], n if not i["name"] else -1), []).append(i)
            for (line, module, level, _), names in statements.items():
                if not any((home := self._read(path, i)) and home != path for i in names):
                    external = level == 0 and module
                    out.append(("EXTERNAL" if external else "UNRESOLVED", path, module.split(".")[0] if external else "", line))
        return out

    def _attribute_type(self, cls: tuple[str, str], name: str) -> tuple[str, str] | None:
        """The class of an attribute whose type the class, or the first base with one, states."""
        for c in self.mro(cls) or []:
            if c not in self.symbols:
                return None
            if stated := self.symbols[c]["locals"].get(name):
                return self._class(c[0], stated)
        return None

    def _class(self, path: str, chain: str) -> tuple[str, str] | None:
        at = self.resolve_chain(path, chain.split("."))
        return at if at and self.symbols[at]["kind"] == "class" else None

    def _of_instance(self, cls: tuple[str, str] | None, names: list[str]) -> tuple[str, str] | None:
        """The member that a chain of attributes of an instance ends in."""
        for i, name in enumerate(names):
            if cls is None:
                return None
            if (at := self._member(cls, [name])) is not None:
                return at if i == len(names) - 1 else None
            cls = self._attribute_type(cls, name)
        return None

    def _call(self, path: str, symbol: dict, chain: list[str]) -> tuple[tuple[str, str] | None, str]:
        own = (path, symbol["parent"])
        head, rest = chain[0], chain[1:]
        if head == "super()" and symbol["parent"]:
            return self._member(own, rest, skip_self=True), "super"
        if symbol["owner"] and head == symbol["owner"]:
            return (self._member(own, rest) if symbol["of_class"] else self._of_instance(own, rest)), "self"
        if head in symbol["locals"]:
            return self._of_instance(self._class(path, symbol["locals"][head]), rest or ["__call__"]), "local-instance"
        if head in symbol["bound"]:
            return None, ""  # a name of the function's own hides the file's
        at = self.resolve_chain(path, chain)
        if at and self.symbols[at]["kind"] == "class":
            return at, "constructor"
        return at, "attribute" if rest else "name"


#: Files of a repository whose names are resolved by one task.
FILES_AT_ONCE = 500


def resolve(analysed: DataFrame, at_once: int = FILES_AT_ONCE) -> DataFrame:
    """(repository, kind, source, target, via, names, first_line, lines, count): merged edges, and
    ``EXTERNAL`` and ``UNRESOLVED`` imports (source: file, target: package).

    ``analysed`` is the result of :func:`analyse`.  A repository's files are dealt into buckets.  A
    bucket's task knows what every file of the repository defines and imports, and the call sites of
    its own files only, so a large repository is shared by many tasks.
    """
    schema = pa.schema([("repository", pa.string()), ("kind", pa.string()), ("source", pa.string()), ("target", pa.string()), ("via", pa.string()), ("names", pa.list_(pa.string())), ("first_line", pa.int64()), ("lines", pa.list_(pa.int64())), ("count", pa.int64())])

    def run(data: pa.Table) -> pa.Table:
        rows = data.drop_columns(["bucket", "buckets"]).to_pylist()
        own = {f["path"] for f in rows if f["own"]}
        files = [{**f, "symbols": [{**s, "locals": dict(s["locals"])} for s in f["symbols"]]} for f in rows]
        whole = Repository(files)
        merged: dict[tuple[str, str, str], list[tuple[int, str]]] = {}
        for kind, source, target, via, line in whole.edges(own):
            merged.setdefault((kind, source, target), []).append((line, via))
        for kind, source, target, line in whole.outside(own):
            merged.setdefault((kind, source, target), []).append((line, ""))
        out = []
        for (kind, source, target), found in sorted(merged.items()):
            if kind == "IMPORTS":  # names in the order of their statements
                names, via = list(dict.fromkeys(v for _, v in found))[:8], ""
                found.sort(key=lambda x: x[0])
            else:
                found.sort()
                names, via = [], found[0][1]
            out.append({"repository": files[0]["repository"], "kind": kind, "source": source, "target": target, "via": via, "names": names, "first_line": found[0][0], "lines": [n for n, _ in found[:20]], "count": len(found)})
        return pa.Table.from_pylist(out, schema=schema)

    return _bucketed(analysed, at_once).applyInArrow(run, "repository string, kind string, source string, target string, via string, names array<string>, first_line long, lines array<long>, count long")


def orders(analysed: DataFrame, at_once: int = FILES_AT_ONCE) -> DataFrame:
    """(repository, cls, position, base): the resolution order of every class (path::name), itself
    first; classes without an order, because their bases disagree, have no rows.
    """
    schema = pa.schema([("repository", pa.string()), ("cls", pa.string()), ("position", pa.int64()), ("base", pa.string())])

    def run(data: pa.Table) -> pa.Table:
        rows = data.drop_columns(["bucket", "buckets"]).to_pylist()
        whole = Repository([{**f, "symbols": [{**s, "locals": dict(s["locals"])} for s in f["symbols"]]} for f in rows])
        out = []
        for f in rows:
            for s in f["symbols"] if f["own"] else ():
                if s["kind"] == "class":
                    for i, (path, name) in enumerate(whole.mro((f["path"], s["name"])) or []):
                        out.append({"repository": f["repository"], "cls": f"{f['path']}::{s['name']}", "position": i, "base": f"{path}::{name}"})
        return pa.Table.from_pylist(out, schema=schema)

    return _bucketed(analysed, at_once).applyInArrow(run, "repository string, cls string, position long, base string")


def _bucketed(analysed: DataFrame, at_once: int):
    """Analysed files grouped by repository and bucket, with ``own`` for the bucket's own files."""
    sizes = analysed.groupBy("repository").agg(F.ceil(F.count("*") / F.lit(at_once)).cast("int").alias("buckets"))
    dealt = analysed.join(sizes, "repository").withColumn("bucket", F.pmod(F.xxhash64("path"), F.col("buckets")).cast("int"))
    own = dealt.withColumn("own", F.lit(True))
    uncalled = F.transform("symbols", lambda s: s.withField("calls", F.array().cast("array<struct<chain:string,line:bigint>>")).withField("called", F.array().cast("array<string>")))
    known = dealt.withColumn("symbols", uncalled).withColumn("own", F.lit(False)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).where("other <> bucket").withColumn("bucket", F.col("other")).drop("other")
    return own.unionByName(known).groupBy("repository", "bucket")
