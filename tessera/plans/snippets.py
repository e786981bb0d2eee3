"""Source snippets that hit a rule, and twins that do not: shared by the registered scans and the tests."""

from __future__ import annotations

#: Deterministic rules by kind: (hit, clean).
DETERMINISTIC = {
    "exception_unwrap": ("try {\n} catch (IOException e) {\n  throw new AppError(e.getMessage());\n}", "try {\n} catch (IOException e) {\n  throw new AppError(e);\n}"),
    "charset_omission": ("byte[] b = s.getBytes();", "byte[] b = s.getBytes(UTF_8);"),
    "close_not_in_finally": ("x = new FileReader(f);\nx.read();", "try (var x = new FileReader(f)) {\n}"),
    "unused_accumulator": ("void run() {\nList<String> seen = new ArrayList<>();\nseen.add(a);\n}", "List<String> run() {\nList<String> seen = new ArrayList<>();\nseen.add(a);\nreturn seen;\n}"),
    "null_deref_after_load": ("User u = repo.findOne(id);\nu.name();", "User u = repo.findOne(id);\nif (u == null) return;"),
    "admin_grant_without_audit": ("if (user.admin) {\n  return true;\n}", "if (user.admin) {\n  audit(user);\n  return true;\n}"),
    "tenant_predicate_missing": ("String tenantId;\n\n\n\n\n\n\n\n\n\nq = \"select * from t where id = ?\"", "String tenantId;\nq = \"select * from t where id = ? and tenant_id = ?\""),
    "tenant_context_dropped": ("pool.submit(() ->\n  ship(orderId));", "pool.submit(() ->\n  ship(orderId, tenant, actor, trace));"),
    "tenant_id_only_lookup": ("void refundOrder(String id) {\n  Order o = repo.findById(id);\n}", "void refundOrder(String id) {\n  Order o = repo.findById(id);\n check(tenant);\n}"),
    "unpooled_connection": ("c = DriverManager.getConnection(url);", "c = pool.getConnection();"),
    "executor_not_shutdown": ("e = Executors.newFixedThreadPool(4);", "e = Executors.newFixedThreadPool(4);\ne.shutdown();"),
    "env_config_gap": ('u = "https://api.staging.example.com/x";', 'u = System.getenv("U"); // https://api.staging.example.com/x'),
    "uncontrolled_log_sink": ("void logIt(String s) {\n  System.out.println(s);\n}", "void other() {\n  System.out.println(1);\n}"),
    "error_payload_candidate": ("Result reject(String code) {\n  return new Result(code);\n}", "Result reject(String code) {\n  return new Result(code, message);\n}"),
    "opaque_status_candidate": ('if (o.status == "F") {', "if (o.status == FAILED) {"),
    "disabled_bound": ("client.setReadTimeout(0);", "client.setReadTimeout(5000);"),
    "retry_side_effect": ("for (int attempt = 0; attempt < 3; attempt++) {\n  gateway.charge(card);\n}", "for (int attempt = 0; attempt < 3; attempt++) {\n  gateway.charge(card, idempotencyKey);\n}"),
    "unguarded_parse": ('n = Integer.parseInt(request.get("n"));', 'if (x != null)\nn = Integer.parseInt(request.get("n"));'),
    "shared_mutable": ("static Map<String, X> m = new HashMap<>();", "static final Map<String, X> m = new ConcurrentMap<>();"),
    "process_default_write": ("TimeZone.setDefault(utc);", "TimeZone.getDefault();"),
    "decision_literal": ("void f() {\n  if (fee > 25) {\n  }\n}", "void f() {\n  if (fee > MAX) {\n  }\n}"),
    "test_tautology": ("assertTrue(true);", "assertTrue(x);"),
    "prod_test_coupling": ("import org.junit.Test;\nimport org.junit.Rule;", "import java.util.List;"),
    "weak_perf_test": ("void t() {\n  assertTrue(elapsed < 5000);\n}", "void t() {\n  http.get();\n  assertTrue(elapsed < 5000);\n}"),
}

#: Signals by kind: (hit, clean).
SIGNALS = {
    "sql_concatenation": ('stmt.execute("select * from t where id = " + id);', 'stmt.execute(SAFE_QUERY);'),
    "sql_variable": ('String q = "select a from t where n = \'" + name;\nstmt.executeQuery(q);', 'String q = load("a.sql");\nstmt.executeQuery(q);'),
    "path_concatenation": ('f = new File(base + name);', 'f = new File(FIXED);'),
    "verifier_returns_true": ("boolean verify(String host) {\n  return true;\n}", "boolean ready(String host) {\n  return true;\n}"),
    "weak_hash": ('d = MessageDigest.getInstance("MD5");', 'd = MessageDigest.getInstance("SHA-256");'),
    "pii_logged": ('log.info("mail " + user.email);', 'log.info(mask(user.email));'),
    "open_sink": ("System.out.println(user);", "System.out.println(total);"),
    "swallowed_error": ("try { go(); } catch (Exception e) { }", "try { go(); } catch (Exception e) { fail(e); }"),
    "missing_timeout": ("r = requests.get(url)", "r = requests.get(url, timeout=5)"),
    "retry_without_backoff": ("while (attempts < 5) {\n  call();\n}", "while (attempts < 5) {\n  call();\n  sleep(backoff);\n}"),
    "fan_out": ("all.parallelStream().map(f);", "all.parallelStream().map(f); // a\nlimit(8);"),
    "destructive_ddl": ("drop table orders;", "create table orders (id int);"),
    "unguarded_flag": ('if (flags.isEnabled("x")) {\n  go();\n}', 'if (flags.isEnabled("x", default)) {\n  go();\n}'),
    "io_in_loop": ("for (Id id : ids) {\n  repo.findOne(id);\n}", "all = repo.findAll(ids);"),
    "unpaged_read": ("rows = repo.findAll();", "rows = repo.findAll(page);"),
    "unbounded_cache": ("Map cache = new HashMap();", "Map cache = new HashMap();\nbuilder.maximumSize(100);"),
    "silent_failure": ("} catch (Exception e) {\n  return null;\n}", "} catch (Exception e) {\n  log.warn(e);\n  return null;\n}"),
    "breaking_contract": ("@Deprecated\nvoid old();", "void current();"),
    "todo_marker": ('x = 1; y = "TODO";', 'x = 1; y = "done";'),
    "floating_version": ('  "left": "^1.2.0"', '  "left": "1.2.0"'),
}

#: Whole files in four languages; @ stands for a number.  Beside each, the (line, kind) of every deterministic hit if the number is 0, and the lines that do not hit otherwise.
MIXED = {
    "pay/Client.java": (
        """package pay;
class Client {
  static final int T = @;
  static final int LATE = 30;
  String v = "a /* b";
  void open(Http http) {
    http.setReadTimeout(T);
    http.setConnectTimeout(LATE);
    TimeZone.setDefault(utc);
  }
  /* TimeZone.setDefault(none); */
  String text(Order order) {
    List<String> seen = new ArrayList<>();
    List<String> kept = new ArrayList<>();
    seen.add(order.a);
    kept.add(order.b); // return seen;
    return kept.toString();
  }
  void logIt(String s) {
    sink(s);
  }
  static {
    System.out.println("ready");
  }
  void load(Repo repo, String id, User other) {
    User u = repo.findOne(id);
    if (other != null) {
      u.greet();
    }
  }
}
""",
        [(7, "disabled_bound"), (9, "process_default_write"), (13, "unused_accumulator"), (26, "null_deref_after_load")],
        [7],
    ),
    "pay/Other.java": (
        """class Other {
  void go(Http http, Pool pool) {
    http.setWriteTimeout(Client.T);
    pool.submit(() -> {
      ship(orderId,
        tenant);
    });
    note(actor, trace);
    for (int attempt = 0; attempt < 3; attempt++) {
      step(attempt);
    }
    gateway.charge(card);
  }
  String refundAll(Repo repo, String id) {
    return "}".repeat(2) + repo.findById(id);
  }
  String plain(Repo repo, String id) {
    return repo.findById(id);
  }
}
""",
        [(3, "disabled_bound"), (4, "tenant_context_dropped"), (15, "tenant_id_only_lookup")],
        [3],
    ),
    "jobs/run.py": (
        '''"""A job # not a comment
TimeZone.setDefault(x)
"""
LIMIT = @
RETRY_ENABLED = True


def total(rows):
    seen = []
    for attempt in range(3):
        text = "send(" + '}'
        publish(rows)
    seen.append(rows)  # return seen
    return text


def other(rows):
    if RETRY_ENABLED:
        out = []
        out.append(rows)
        return out


def last(store, key):
    item = store.load_item(key)
    if item is None:
        return 0
    return item.size
''',
        [(9, "unused_accumulator"), (12, "retry_side_effect"), (18, "disabled_bound")],
        [],
    ),
    "svc/load.go": (
        """package svc

const wait = @

func (s *Store) Load(id string) error {
	q := `// raw {
`
	err := s.run(q)
	if err != nil {
		return fmt.Errorf("load: %v", err)
	}
	return fmt.Errorf("load: %w", err)
}

func (s *Store) Open(c *Conn) {
	c.SetTimeout(wait)
}
""",
        [(10, "exception_unwrap"), (16, "disabled_bound")],
        [16],
    ),
    "web/list.ts": (
        """const items = (rows: Row[]) => {
  const seen: string[] = [];
  for (const row of rows) {
    seen.push(row.name);
  }
  const url = "http://x.example/*";
  return url;
};
function reject(code: string) {
  const m = `{${code}`;
  return { code };
}
function accept(code) {
  message(code);
}
""",
        [(2, "unused_accumulator")],
        [],
    ),
}
