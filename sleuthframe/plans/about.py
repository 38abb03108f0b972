"""One line on each check, for the command line's list."""

from __future__ import annotations

ABOUT = {
    "shared-mutable-module-state": "a module's mutable value is changed from other modules",
    "write-only-attributes": "a field is set but read nowhere",
    "temporal-coupling": "a method works only after another one has set its state",
    "feature-envy": "a method uses another object more than its own",
    "anemic-domain": "a class holds data that functions elsewhere work on",
    "unused-defaults": "every caller passes a parameter that defaults to None",
    "dead-code": "a public function that nothing refers to",
    "single-call-site": "a function with one caller",
    "internal-only": "a public function called only in its own file",
    "constant-args": "all callers pass one and the same value",
    "return-none-instead-of-raise": "callers treat None as failure, one after the other",
    "pass-through-params": "a parameter is only handed on",
    "inconsistent-error-handling": "some callers guard a call, others don't",
    "vestigial-params": "a parameter that the body never uses",
    "dict-as-dataclass": "dicts with the same keys, read by those keys",
    "dead-exceptions": "an exception class that nothing raises or catches",
    "dead-dispatch-entries": "a dispatch table's key that nothing looks up",
    "orphaned-test-helpers": "a test helper that no test uses",
    "dead-abstraction": "an abstract class without a subclass",
    "broken-backends": "a method that only raises NotImplementedError",
    "compat-shims": "code for versions that are no longer supported",
    "suspicious-fallbacks": "a default that hides a missing key",
    "exception-flow-control": "an exception raised and caught in one function",
    "unreachable-after-return": "statements that can't be reached",
    "foo-equals-foo": "a call that passes many names on as they are",
    "constant-dispatch-dicts": "a dict of constants, built to be indexed once",
    "trivial-wrappers": "a function that only calls another one",
    "dead-constants": "a constant that nothing reads",
    "temp-accumulators": "a list filled in a loop, then only joined or returned",
    "env-fallbacks": "an environment variable with a default in the code",
    "runtime-monkey-patch": "an attribute of an imported module or class is replaced",
    "fossilized-toggles": "a flag that never changes",
    "isinstance-chain": "a chain of type tests on one value",
    "boolean-param-explosion": "many boolean parameters",
    "arrow-code": "deeply nested blocks",
    "inconsistent-returns": "some paths return a value, others nothing",
    "law-of-demeter": "long chains of attributes",
    "hungarian-notation": "names that carry their type",
    "plaintext-passwords": "a secret written in the code",
    "getattr-strings": "getattr with a literal name",
    "late-binding-closures": "a closure over a loop's variable",
    "stdlib-alternatives": "a package for what the standard library has",
    "scattered-constants": "one value in constants of several files",
    "scattered-isinstance": "one type tested for in many files",
    "shotgun-surgery": "one attribute tested for in many files",
    "repeated-string-parsing": "the same splitting of strings in many places",
    "duplicate-blocks": "equal blocks of statements",
    "duplicate-except-blocks": "equal handlers",
    "param-clumps": "parameters that go together in many functions",
    "middle-man": "a class whose methods only delegate",
    "shadowed-method": "a method that overrides one by the same code",
    "large-class": "a class of many methods or lines",
    "long-function": "a function of many lines",
    "long-elif-chain": "a long chain of elif",
    "bug-magnet": "a file whose commits are mostly fixes",
    "fix-propagation": "fixes that touch many files",
    "fix-follows-feature": "features that need a fix soon after",
    "stabilization-failure": "fixes that go on for weeks",
    "blast-radius": "a file whose commits touch many others",
    "change-coupling": "files that change together without an import",
    "yo-yo-code": "lines added and removed again and again",
    "conscious-debt": "commits that say they leave debt",
    "emergency-hotspots": "hotfixes and reverts in one place",
    "no-refactoring": "a growing file that is never refactored",
    "test-erosion": "code changes without its tests",
    "growth-trajectory": "a file that only grows",
    "churn-without-growth": "much rewritten, little added",
    "hotspot-acceleration": "a file that changes ever more often",
    "abandoned-code": "a file left behind while its package moves on",
    "knowledge-silo": "a file that one author writes",
    "divergent-change": "a file changed for unrelated reasons",
}
