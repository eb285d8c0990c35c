"""Arguments with nested brackets and quoted commas, and the routes that three frameworks register."""

from loomgraph.plans.routes import decorated, listed, routes
from loomgraph.sources import arguments as A


def test_arguments():
    assert A.split("'/a,b', f(1, [2, 3]), x={'k': (1, 2)}, \"c)\", ") == ["'/a,b'", "f(1, [2, 3])", "x={'k': (1, 2)}", '"c)"']
    assert A.first_string("\n  '/it\\'s', x") == "/it\\'s" and A.first_string("f'/x'") is None and A.first_string("['/x']") is None and A.first_string("'open") is None
    assert A.keyword("'/x', other_methods=['NO'], methods=['GET', 'a,b'], z=1", "methods") == "['GET', 'a,b']" and A.keyword("'methods=1'", "methods") is None and A.keyword("methods==1", "methods") is None
    assert A.names("['get', \"a,b\"]") == ["GET", "A,B"] and A.names("('get', 'post')") == ["GET", "POST"] and A.names("'put'") == ["PUT"] and A.names("[]") == []
    assert list(A.calls_of("[path('a', f(x)), re_path('b)', g), url('c', path('d'))] + path('cut'", ("path", "re_path", "url"))) == ["'a', f(x)", "'b)', g", "'c', path('d')"]


def test_decorators():
    assert decorated("app.route('/x', methods=['GET', 'POST'], defaults={'a': [1, 2]})", False) == [("flask", "GET", "/x"), ("flask", "POST", "/x")]
    assert decorated("bp.route('/x')", True) == [("flask", "ANY", "/x")] and decorated("app.route(path)", False) == [] and decorated("property", False) == []
    assert decorated("app.get('/x', tags=['a'])", False) == [("flask", "GET", "/x")] and decorated("app.get('/x')", True) == [("fastapi", "GET", "/x")]
    assert decorated("router.delete('/x')", False) == [("fastapi", "DELETE", "/x")] and decorated("api_router.trace('/x')", True) == [("fastapi", "TRACE", "/x")]
    assert decorated("bp.get('/x')", True) == [] and decorated("router.route('/x')", True) == [] and decorated("app.trace('/x')", False) == []


def test_listed():
    text = "[path('a/', views.home, name='x, y'), re_path('^b$', Detail.as_view(template=('t', 1))), path('c/', include('shop.urls')), path(name, views.no), url('d', wrap(views.e))]"
    assert listed(text) == [("a/", "home"), ("^b$", "Detail"), ("c/", None), ("d", "wrap")]


def test_routes(spark):
    fn = lambda id_, title, path, decorators=(), depth=0: (id_, title, path, list(decorators), depth)
    functions = spark.createDataFrame([
        fn("w.show", "show", "w.py", ["app.get('/s')", "cache"]), fn("f.show2", "show2", "f.py", ["app.get('/s')"]), fn("v.home", "home", "v.py"), fn("v.two", "two", "v.py"), fn("u.two", "two", "u.py"),
        fn("v.make.inner", "inner", "v.py", (), 1), fn("urls.make.local", "local", "urls.py", (), 1),
    ], "id string, title string, file_path string, decorators array<string>, nesting_depth long")
    facts = spark.createDataFrame([("w.py", [("flask.Flask", 1)]), ("f.py", [("fastapi.FastAPI", 1)]), ("v.py", [("fastapix", 1)]), ("urls.py", [])], "path string, imports array<struct<name:string,line:long>>")
    constants = spark.createDataFrame([("urls.urlpatterns", "urlpatterns", "urls.py", "[path('h', v.home), path('t', v.two), path('i', inner), path('l', local)]"), ("x", "OTHER", "x.py", "path('no', home)"), ("y", "urlpatterns", "y.py", None)], "id string, title string, file_path string, value_preview string")
    nodes, edges = routes(functions, facts, constants)
    assert {r.id for r in nodes.collect()} == {"flask::GET::/s::w.py", "fastapi::GET::/s::f.py", *(f"django::ANY::{p}::urls.py" for p in "htil")}
    assert {(r.src, r.dst) for r in edges.collect()} == {("flask::GET::/s::w.py", "w.show"), ("fastapi::GET::/s::f.py", "f.show2"), ("django::ANY::h::urls.py", "v.home"), ("django::ANY::l::urls.py", "urls.make.local")}
