from bidlattice.sources import code, parsers

PY = '''"""Models."""
import os
from app import base


class Animal(base.Root):
    """An animal."""

    def speak(self, loud: bool = False) -> str:
        return make(loud)


class Dog(Animal):
    def speak(self, loud=False):
        return super().speak(loud)


def make(loud):
    """Makes a sound."""
    return os.path.join("a", "b")


@app.get("/sounds")
async def sounds():
    return make(True)
'''
TS = """import { x } from './x';
export interface Shape extends Base { a: number }
export type Id = string;
export enum Color { Red }
export class Circle extends Round {}
export async function area(c: Circle) { return 1; }
export const twice = (n: number) => n * 2;
router.get('/shapes', area);
export { y } from './y';
"""
SQL = """create table users (id int primary key, name varchar(10, 2), foreign key (id) references orgs(id));
CREATE TABLE IF NOT EXISTS orgs (id int);
select * from users u join orgs o on o.id = u.id; insert into users values (1); delete from orgs;
"""
FLOW = "name: ci\non: push\njobs:\n  test:\n    runs-on: x\n  deploy:\n    needs: test\n"


def tree(tmp_path):
    for name, text in {"src/pkg/models.py": PY, "web/shape.ts": TS, "db/schema.sql": SQL, ".github/workflows/ci.yml": FLOW, ".env.example": "A_KEY=1\nB=2\n", "conf.json": '{"k": 1}', "bad.py": "def (", "node_modules/x.js": "class No {}", "big.py": "#" * (parsers.MOST_BYTES + 1)}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return f"file://{tmp_path}"


def test_index_and_queries(spark, tmp_path):
    g = code.CodeGraph(*code.index(spark, tree(tmp_path)))
    e = {(r.kind, r.qualified_name) for r in g.entities.collect()}
    for want in (("class", "pkg.models.Dog"), ("method", "pkg.models.Animal.speak"), ("function", "pkg.models.make"), ("api_route", "pkg.models:GET /sounds"), ("interface", "web.shape.Shape"), ("type_alias", "web.shape.Id"),
                 ("enum", "web.shape.Color"), ("function", "web.shape.area"), ("function", "web.shape.twice"), ("api_route", "web.shape:GET /shapes"), ("sql_table", "users"), ("sql_column", "users.name"), ("config_key", ".env.example:A_KEY"),
                 ("pipeline_stage", ".github/workflows/ci.yml#deploy"), ("config_key", "conf.json:k")):
        assert want in e, want
    assert not any("bad" in q or "No" == q.split(".")[-1] for _, q in e)
    up, down = g.inheritance("pkg.models.Dog")
    assert [r.qualified_name for r in up.collect()] == ["pkg.models.Animal"] and down.count() == 0
    assert {r.qualified_name for r in g.callers("pkg.models.make").collect()} == {"pkg.models.Animal.speak", "pkg.models.sounds"}
    assert {r.qualified_name for r in g.callees("pkg.models.Animal.speak").collect()} == {"pkg.models.make"}
    assert {r.table: r.columns for r in g.tables().collect()} == {"users": ["id", "name"], "orgs": ["id"]}
    assert {(r.usage) for r in g.table_usage("users").collect()} == {"uses_table", "writes_column"}
    assert {r.name for r in g.routes().collect()} == {"GET /sounds", "GET /shapes"}
    assert [r.kind for r in g.imports("shape.ts").collect()] == ["imports", "re_exports"]
    assert [x.name for x in g.outline("models.py").first().entities][:2] == ["models", "Animal"]
    assert g.search("sound").first().qualified_name in ("pkg.models.sounds", "pkg.models.make", "pkg.models:GET /sounds")
    pack = g.context_pack("make sounds", 40).collect()
    assert pack and sum(r.tokens for r in pack) <= 40
    nodes, edges = g.subgraph("pkg.models.make", 1)
    assert nodes.count() == 1 and edges.count() >= 3
    assert {r.language: r.files for r in g.statistics().collect()}["python"] == 1
    e2, r2 = code.reindex(g.entities, g.relations, g.entities.limit(0), g.relations.limit(0), spark.createDataFrame([("src/pkg/models.py",)], "file_path string"))
    assert e2.filter("file_path = 'src/pkg/models.py'").count() == 0 and r2.filter("file_path = 'src/pkg/models.py'").count() == 0


def test_only_changed_files_are_parsed_again(spark, tmp_path):
    root, kept = tree(tmp_path / "tree"), f"file://{tmp_path}/kept"
    (tmp_path / "tree" / ".gitignore").write_text("web/\n*.json\n!conf.json\n")
    e, _, counts = code.refresh(spark, root, kept)
    assert counts["kept"] == 0 and not e.filter("file_path like 'web/%'").count() and e.filter("file_path = 'conf.json'").count()
    (tmp_path / "tree" / "src/pkg/models.py").write_text(PY.replace("Dog", "Cat"))
    (tmp_path / "tree" / "conf.json").unlink()
    e, r, after = code.refresh(spark, root, kept)
    assert after == {"parsed": 1, "kept": counts["parsed"] - 2, "dropped": 1}
    names = {x.qualified_name for x in e.collect()}
    assert "pkg.models.Cat" in names and "pkg.models.Dog" not in names and "conf.json" not in names
    assert r.filter("kind = 'decorated_by'").count() == 1


def test_script_and_sql_tokens():
    e, r = parsers.parse("a.js", "// class No {}\nconst s = `class Nope {`, q = require('r');\nconst f = async (a) => a; let g = x => x; const o = {type: 1};\nexport default class K<T> extends a.B<T> implements I {}\nobj.class.foo; import type { T } from './t';")
    assert {x[1] for x in e} == {"a", "f", "g", "K"} and {x[2] for x in r if x[1] in ("imports", "inherits")} == {"r", "a.B", "./t"}
    e, r = parsers.parse("a.sql", "create or replace temp table \"x y\" (a int default 'it''s, ok', primary key (a)); -- from no\nalter table s.t add column if not exists c int check (c in (1, 2)), add d text; select 1 from b for update; delete from z")
    assert [x[2] for x in e[1:]] == ["x y", "x y.a", "t.c", "t.d"]
    assert {(x[1], x[2]) for x in r if not x[4]} == {("writes_column", "t"), ("uses_table", "b"), ("uses_table", "z"), ("writes_column", "z")}
