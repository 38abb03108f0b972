"""A code base made of table rows, to run the checks over where no source code is at hand.

Each supplier becomes one module, or a few, written after the check's sample:
the first variant, which the check reports, for suppliers with a balance of
BALANCE or more, the second one, just short of it, for all others. Names and
literals carry the supplier's key, so that the expected findings follow from
the table. In the samples the sign § stands for the key, >> begins another module.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..cluster import spread

BALANCE = 4000
MANY = "\n".join(f"    def m{i}(self):\n        return {i}" for i in range(20))
LONG = "    step(x)\n" * 98 + "    step(x)"
CHAIN = "\n".join(f"    elif v == {i}:\n        return {i}" for i in range(1, 8))

TEXT = """
== shared-mutable-module-state 1 medium
REG§ = []
>> _b
from mod import REG§
REG§.append(1)
--
REG§ = []
>> _b
from mod import REG§
def later():
    REG§.append(1)
== write-only-attributes 4 medium
from dataclasses import dataclass
@dataclass
class C§:
    field§: int = 0
--
from dataclasses import dataclass
@dataclass
class C§:
    field§: int = 0
print(C§().field§)
== temporal-coupling 1 medium
class T§:
    def __init__(self):
        self.a = 1
    def load(self):
        self.rows = []
    def use(self):
        return self.rows
--
class T§:
    def __init__(self):
        self.rows = 1
    def load(self):
        self.rows = []
    def use(self):
        return self.rows
== feature-envy 2 medium
class E§:
    def total(self, other):
        return other.a + other.b + other.c
--
class E§:
    def total(self, other):
        return other.a + other.b + other.c + self.x + self.y + self.z
== anemic-domain 1 medium
class B§:
    def __init__(self):
        self.a = self.b = self.c = self.d = self.e = 0
--
class B§:
    def __init__(self):
        self.a = self.b = self.c = self.d = self.e = 0
    def go(self):
        return 1
== unused-defaults 1 high
def pay§(x, tip=None):
    return x
pay§(1, tip=2)
pay§(1, 3)
--
def pay§(x, tip=None):
    return x
pay§(1, tip=2)
pay§(1)
== dead-code 1 high
def orphan§():
    return 1
--
def orphan§():
    return 1
>> _b
from mod import orphan§
== single-call-site 1 low
def once§(a):
    return a + 1
once§(2)
--
def once§(a):
    return a + 1
once§(2)
once§(3)
== internal-only 1 low
def near§(a):
    return a + 1
near§(2)
near§(3)
--
def near§(a):
    return a + 1
near§(2)
near§(3)
>> _b
near§(4)
== constant-args 1 medium
def f§(a, mode):
    return a
f§(1, "x")
f§(2, mode="x")
--
def f§(a, mode):
    return a
f§(1, "x")
f§(2, mode="y")
== return-none-instead-of-raise 1 medium
def find§(x):
    if x:
        return None
    return 1
def a():
    r = find§(1)
    if r is None:
        return 0
def b():
    r = find§(2)
    if not r:
        return 0
--
def find§(x):
    if x:
        return None
    return 1
def a():
    r = find§(1)
    if r is None:
        return 0
def b():
    r = find§(2)
    print(r)
== pass-through-params 1 medium
def outer§(conf):
    return inner§(conf)
def inner§(conf):
    return conf.a
outer§(1)
--
def outer§(conf):
    return inner§(conf.b)
def inner§(conf):
    return conf.a
outer§(1)
== inconsistent-error-handling 1 medium
def risky§():
    return 1
def a§():
    try:
        risky§()
    except ValueError:
        pass
def b§():
    try:
        risky§()
    except ValueError:
        pass
def c§():
    risky§()
--
def risky§():
    return 1
def a§():
    try:
        risky§()
    except ValueError:
        pass
def b§():
    try:
        risky§()
    except ValueError:
        pass
def c§():
    risky§()
def d§():
    c§()
def e§():
    try:
        d§()
    except ValueError:
        pass
== vestigial-params 1 medium
def v§(a, b):
    return a
--
def v§(a, b):
    return a + b
== dict-as-dataclass 1 medium
def d§():
    return {"red": 7, "green": 8, "blue": 9, "alpha": 0}
--
def d§():
    return {"red": 7, "green": 8, "blue": 9}
== dead-exceptions 1 high
class Bad§Error(Exception):
    pass
--
class Bad§Error(Exception):
    pass
>> _b
raise Bad§Error()
== dead-dispatch-entries 3 medium
def h():
    return 1
TABLE = {"run§": h, "stop§": h, "go§": h}
print("run§", "stop§")
--
def h():
    return 1
TABLE = {"run§": h, "stop§": h, "go§": h}
print("run§", "stop§", "go§")
== orphaned-test-helpers 1 medium test_
def helper§():
    return 1
--
def helper§():
    return 1
def test_it():
    helper§()
== dead-abstraction 2 medium
from abc import ABC
class Base§(ABC):
    pass
--
from abc import ABC
class Base§(ABC):
    pass
>> _b
class Real§(Base§):
    pass
== broken-backends 1 medium
class Store§:
    def get(self):
        raise NotImplementedError
    def put(self):
        raise NotImplementedError("put")
--
class Store§:
    def get(self):
        raise NotImplementedError
    def put(self):
        return 1
== compat-shims 1 high
try:
    import fast§
except ImportError:
    fast§ = None
--
try:
    import fast§
except ValueError:
    fast§ = None
== suspicious-fallbacks 2 high
TABLE = {"a": §}
TABLE.get("b", 7)
--
TABLE = {"a": §}
TABLE.get("b", 0)
== exception-flow-control 4 medium
class JumpError(Exception):
    pass
def f§():
    try:
        raise JumpError()
    except JumpError:
        return 1
--
class JumpError(Exception):
    pass
def f§():
    try:
        raise JumpError()
    except ValueError:
        return 1
== unreachable-after-return 3 high
def f§():
    return 1
    print(2)
--
def f§():
    print(2)
    return 1
== foo-equals-foo 6 medium
def f§():
    a = 1
    b = 2
    c = 3
    d = 4
    return g(a=a, b=b, c=c, d=d)
--
def f§(a, b, c, d):
    return g(a=a, b=b, c=c, d=d)
== constant-dispatch-dicts 1 medium
TABLE = {"a": f§, "b": g, "c": h}
--
TABLE = {"a": f§, "b": g}
== trivial-wrappers 1 low
def wrap§(x):
    return other(x)
--
def wrap§(x):
    return other(x, §)
== dead-constants 1 medium
LIMIT§ = 77
--
LIMIT§ = 77
>> _b
print(mod.LIMIT§)
== temp-accumulators 2 medium
def f§(xs):
    out = []
    for x in xs:
        out.append(x)
    return ",".join(out)
--
def f§(xs):
    out = []
    for x in xs:
        out.append(x)
    return out
== env-fallbacks 2 high
import os
A§ = os.environ.get("KEY§", "fallback")
--
import os
A§ = os.environ.get("KEY§", None)
== runtime-monkey-patch 3 medium
def patched():
    return §
other.method = patched
--
def patched():
    return §
method = patched
== fossilized-toggles 1 medium
USE_NEW§ = False
if USE_NEW§:
    print(1)
--
USE_NEW§ = False
USE_NEW§ = True
if USE_NEW§:
    print(1)
== isinstance-chain 1 medium
def f§(x):
    return isinstance(x, int), isinstance(x, str), isinstance(x, set), isinstance(x, list), isinstance(x, dict)
--
def f§(x):
    return isinstance(x, int), isinstance(x, str), isinstance(x, set), isinstance(x, list)
== boolean-param-explosion 1 medium
def f§(a=True, b=False, c=True, *, d=False):
    return a
--
def f§(a=True, b=False, c=True, *, d=0):
    return a
== arrow-code 1 low
def f§(x):
    if x:
        for y in x:
            while y:
                with y:
                    if x:
                        return 1
--
def f§(x):
    if x:
        for y in x:
            while y:
                with y:
                    return 1
== inconsistent-returns 1 medium
def f§(x):
    if x is a:
        return 1
    if x is b:
        return "two"
    return [3]
--
def f§(x):
    if x is a:
        return 1
    if x is b:
        return "two"
    return "three"
== law-of-demeter 1 low
value = order§.customer.address.city
--
value = order§.customer.address
== hungarian-notation 1 low
strName§ = 1
--
structure§ = 1
== plaintext-passwords 1 high
ok = user.password == entered§
--
ok = user.name == entered§
== getattr-strings 1 medium
value = getattr(obj§, "name§")
--
value = getattr(obj§, "name§", None)
== late-binding-closures 2 high
for i in range(§):
    calls.append(lambda: i)
--
for i in range(§):
    calls.append(lambda i=i: i)
== stdlib-alternatives 1 low
import ftplib
--
import pathlib
== scattered-constants 1 low
NAME = "value-§"
>> _b
NAME = "value-§"
>> _c
NAME = "value-§"
--
NAME = "value-§"
>> _b
NAME = "value-§"
>> test_c
NAME = "value-§"
== scattered-isinstance 1 medium
class Kind§:
    pass
ok = isinstance(x, Kind§)
>> _b
ok = isinstance(x, Kind§)
>> _c
ok = isinstance(x, (int, Kind§))
--
class Kind§:
    pass
ok = isinstance(x, Kind§)
>> _b
ok = isinstance(x, Kind§)
== shotgun-surgery 4 medium
class Order§:
    def __init__(self):
        self.total§ = 0
print(order.total§)
>> _b
print(order.total§)
>> _c
print(order.total§)
>> _d
print(order.total§)
--
class Order§:
    def __init__(self):
        self.total§ = 0
print(order.total§)
>> _b
print(order.total§)
>> _c
print(order.total§)
== repeated-string-parsing 1 medium
a = line.split("<§>")[1]
>> _b
a = line.split("<§>")[1]
>> _c
def f():
    parts = line.split("<§>")
    return parts[1]
--
a = line.split("<§>")[1]
>> _b
a = line.split("<§>")[1]
== duplicate-blocks 2 medium
def f(x):
    a = read§(x)
    b = clean§(a)
    c = sort§(b)
    d = pack§(c)
    send§(d)
>> _b
def g(y):
    p = read§(y)
    q = clean§(p)
    r = sort§(q)
    s = pack§(r)
    send§(s)
--
def f(x):
    a = read§(x)
    b = clean§(a)
    c = sort§(b)
    d = pack§(c)
    send§(d)
>> _b
def g(y):
    p = read§(y)
    q = clean§(p)
    r = sort§(q)
    s = pack§(r)
== duplicate-except-blocks 4 medium
def f():
    try:
        go()
    except ValueError:
        log("failed §")
        stop()
>> _b
def g():
    try:
        go()
    except ValueError:
        log("failed §")
        stop()
--
def f():
    try:
        go()
    except ValueError:
        log("failed §")
        stop()
>> _b
def g():
    try:
        go()
    except ValueError:
        log("stopped §")
        stop()
== param-clumps 1 medium
def f(host§, port§, user§):
    return host§
def g(host§, port§, user§, extra):
    return extra
>> _b
def h(host§, port§, user§, other):
    return other
--
def f(host§, port§, user§):
    return host§
>> _b
def h(host§, port§, user§, other):
    return other
== middle-man 1 medium
class Proxy§:
    def a(self):
        return self.real.a()
    def b(self):
        return self.real.b()
    def c(self):
        self.real.c()
--
class Proxy§:
    def a(self):
        return self.real.a()
    def b(self):
        return self.real.b()
    def c(self):
        return 1
== shadowed-method 7 medium
class A§:
    def run(self):
        return 1
class B§:
    def run(self):
        return 2
class C§(A§, B§):
    pass
--
class A§:
    def run(self):
        return super().run()
class B§:
    def run(self):
        return 2
class C§(A§, B§):
    pass
== large-class 1 low
class Big§:
%MANY
--
class Big§:
    def __init__(self):
        self.a = 1
== long-function 1 low
def f§():
%LONG
--
def f§():
    return 1
== long-elif-chain 2 low
def f§(v):
    if v == 0:
        return 0
%CHAIN
--
def f§(v):
    if v == 0:
        return 0
    elif v == 1:
        return 1
""".replace("%MANY", MANY).replace("%LONG", LONG).replace("%CHAIN", CHAIN)


@dataclass(frozen=True)
class Sample:
    line: int
    severity: str
    prefix: str
    bad: str
    good: str

    def files(self, g: int, k: int, bad: bool) -> list[tuple[str, str]]:
        """(path, source) of supplier k in nation g; the first one is the module the finding points to."""
        out, suffix, src = [], "", ""
        for line in [*(self.bad if bad else self.good).replace("§", str(k)).split("\n"), ">> "]:
            if line.startswith(">> "):
                name = f"{suffix}{k}" if suffix.startswith("test_") else f"{self.prefix}mod{k}{suffix}"
                out.append((f"pkg{g}/{name}.py", src))
                suffix, src = line[3:], ""
            else:
                src += line + "\n"
        return out


def _parse() -> dict[str, Sample]:
    out = {}
    for part in TEXT.strip().removeprefix("== ").split("\n== "):
        head, _, body = part.partition("\n")
        name, line, severity, *prefix = head.split()
        bad, _, good = body.partition("\n--\n")
        out[name] = Sample(int(line), severity, "".join(prefix), bad, good)
    return out


SAMPLES = _parse()


def code_base(suppliers: DataFrame, check: str) -> DataFrame:
    """(path, src): the modules of all suppliers (s_suppkey, s_nationkey, s_acctbal)."""
    sample = SAMPLES[check]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [f for k, g, a in zip(b["s_suppkey"].to_pylist(), b["s_nationkey"].to_pylist(), b["s_acctbal"].to_pylist()) for f in sample.files(g, k, a is not None and a >= BALANCE)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.string()), pa.array([s for _, s in got], pa.string())], ["path", "src"])

    return spread(suppliers.select("s_suppkey", "s_nationkey", "s_acctbal")).mapInArrow(run, "path string, src string")


def expected_sql(check: str) -> str:
    s = SAMPLES[check]
    path = f"'pkg' || s_nationkey || '/{s.prefix}mod' || s_suppkey || '.py'"
    sql = f"select {path} as file, {s.line}::int as line, '{check}' as \"check\", '{s.severity}' as severity from supplier where s_acctbal >= {BALANCE}"
    # One finding for the whole code base, at its first file.
    return f"{sql} order by 'pkg' || s_nationkey, 'mod' || s_suppkey || '.py' limit 1" if check == "stdlib-alternatives" else sql
