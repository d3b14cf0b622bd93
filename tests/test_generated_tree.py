"""A run over a generated tree against a direct Python model of the manifest:
after every step the run must report what the model says and publish what the
model holds."""

import hashlib
import os
import random
import shutil

from lakeaudit.plans.run import update


class Tree:
    """A random tree on disk, changed step by step."""

    def __init__(self, root, seed):
        self.root, self.rng, self.clock = root, random.Random(seed), 1_500_000_000
        for k in range(18):
            self.put("/".join(f"g{self.rng.randrange(4)}" for _ in range(1 + k % 3)) + f"/n{k}.bin")

    def put(self, rel, back=0):
        full = os.path.join(self.root, rel)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(self.rng.randbytes(self.rng.randrange(1, 400)))
        self.clock += 60
        os.utime(full, (self.clock - back, self.clock - back))

    def files(self, include_dot=False):
        out = {}
        for top, dirs, names in os.walk(self.root):
            if not include_dot:
                dirs[:] = [d for d in dirs if not d.startswith(".")]
            for n in names:
                if include_dot or not n.startswith("."):
                    full = os.path.join(top, n)
                    with open(full, "rb") as f:
                        out[os.path.relpath(full, self.root)] = (int(os.stat(full).st_mtime) * 1000, hashlib.md5(f.read()).hexdigest())
        return out

    def dirs(self):
        return {os.path.relpath(os.path.join(t, d), self.root) for t, ds, _ in os.walk(self.root) for d in ds}


def statuses(held, now):
    out = {}
    for p in now:
        if p not in held:
            out[p] = "new"
        elif held[p][1] == now[p][1]:
            out[p] = "ok"
        else:
            out[p] = "DMG" if held[p][0] == now[p][0] else "upd" if held[p][0] < now[p][0] else "old"
    return out


def test_steps_against_a_model(spark, tmp_path):
    tree, store, held = Tree(str(tmp_path / "root"), 11), str(tmp_path / "store"), {}
    some = lambda k: tree.rng.sample(sorted(tree.files()), k)
    gone: set = set()

    def drop_dir():
        victim = min(tree.dirs(), key=lambda d: (d.count("/"), d))
        shutil.rmtree(os.path.join(tree.root, victim))
        gone.add(victim)

    def drop_file():
        p = some(1)[0]
        os.remove(os.path.join(tree.root, p))
        gone.add(p)

    def rewrite():
        a, b = some(2)
        tree.put(a)
        tree.put(b, back=10 ** 6)

    steps = [lambda: None, rewrite, drop_dir, drop_file, lambda: tree.put("g9/g9/.late"), lambda: tree.put("g9/one.bin")]
    for step in steps:
        step()
        now = tree.files()
        res = update(spark, tree.root, store, log_deleted=True)
        got = {r["path"]: r["status"] for r in res.events.where("status <> 'ign'").collect()}
        want = statuses(held, now) | {p: "del" for p in gone}
        assert got == want
        s = res.summary.first()
        assert (s["new"], s["del"], s["upd"]) == tuple(sum(v in k for v in want.values()) for k in (("new",), ("del",), ("upd", "old")))
        held, gone = now, set()
        assert {r["path"]: (r["mod_ms"], r["hash"]) for r in res.next_manifest.collect()} == held
    # hidden names only when they are asked for
    res = update(spark, tree.root, store, include_dot=True, skip_existing=True)
    assert sorted(r["path"] for r in res.events.where("status = 'new'").collect()) == ["g9/g9/.late"]
