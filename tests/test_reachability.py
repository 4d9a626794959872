"""Functions that nothing live calls."""

from sparkloom.plans.scan import scan

TREE = {
    "a.py": "__all__ = ['offered']\n\ndef offered():\n    return helper()\n\ndef helper():\n    def inner():\n        return deep()\n    return inner()\n\ndef deep():\n    return 1\n",
    "b.py": "def lonely():\n    return friend()\n\ndef friend():\n    return lonely()\n\ndef alone():\n    return alone()\n\ndef never():\n    return offered()\n",
    "c.py": "@app.route('/')\ndef page():\n    return shown()\n\ndef shown():\n    return 1\n\nclass K:\n    def __init__(self):\n        self.built()\n\n    def built(self):\n        pass\n",
    "d.py": "def early():\n    pass\n\nearly()\n\ndef main():\n    later()\n\ndef later(): return last()\n\ndef last(): pass\n",
    "e.js": "function used() { return 1 }\nused();\nfunction gone() { return goneToo() }\nfunction goneToo() { return 1 }\n",
}


def test_what_only_dead_functions_call_is_dead(spark, tree):
    s = scan(spark, tree(TREE))
    got = {(r["symbol"], r["file"], r["reason"]) for r in s.unreachable().collect()}
    assert got == {("lonely", "b.py", "dead_callers"), ("friend", "b.py", "dead_callers"), ("alone", "b.py", "dead_callers"), ("never", "b.py", "no_callers"), ("gone", "e.js", "no_callers"), ("goneToo", "e.js", "dead_callers")}
    assert {(r["symbol"], r["file"]) for r in s.dead_code.collect()} <= {(a, b) for a, b, _ in got}
    s.release()


def test_nothing_is_dead_where_nothing_is(spark, tree):
    s = scan(spark, tree({"x.py": "y = 1\n"}))
    assert s.unreachable().count() == 0
    s.release()
