"""The same queries in plain SQL, for checking."""

from __future__ import annotations

from relaylog.sources.replies import HELP_TEXT

_MESSAGES = """
e as (select *, cast(json_extract_string(props, '$.k') as int) as k, epoch_us(ts) // 1000000 as sec from events),
m as (
  select event_id, ts, user_id as channel, k, sec,
    case when event_type in ('signup', 'purchase') then 'PUT'
         when event_type = 'click' then 'GET'
         when event_type = 'view' then case when k % 5 = 0 then 'HEAD' else 'GET' end
         else case when k = 99 then 'DELETE' else 'POST' end end as method,
    (cast(sec as bigint) << 32) | event_id as uid
  from e),
w1 as (
  select *, row_number() over o as pos,
    sum(case when method = 'PUT' then 1 else 0 end) over o as puts,
    sum(case method when 'PUT' then 1 when 'GET' then -1 else 0 end) over o as s
  from m window o as (partition by channel order by ts, event_id rows between unbounded preceding and current row)),
w2 as (
  select *, least(0, min(s) over (partition by channel order by pos rows between unbounded preceding and current row)) as mn,
    least(0, coalesce(min(s) over (partition by channel order by pos rows between unbounded preceding and 1 preceding), 0)) as mnp
  from w1),
walk as (
  select *, cast(s - mn as bigint) as depth, method = 'GET' and s >= mnp as popped, cast(puts - (s - mn) as bigint) as pops
  from w2),
p as (select channel, puts as seq, uid, event_id as put_id, ts as put_ts, k as put_k, pos as put_pos from walk where method = 'PUT'),
g as (select channel, pops as seq, event_id as get_id, ts as get_ts, pos as get_pos from walk where popped)
"""

_LOG = _MESSAGES + """,
f as (
  select w.*, case when method <> 'POST' then null when w.k % 10 = 9 then null when w.k % 10 = 8 then 'bad'
    else coalesce(cast(p.uid as varchar), '0') end as fwd
  from walk w left join p on w.method = 'POST' and p.channel = w.channel and p.seq = w.puts - w.k % 4),
c as (
  select f.channel, p.seq, f.event_id as post_id, f.ts as post_ts, f.pos as post_pos,
    row_number() over (partition by f.channel, p.seq order by f.pos) as n
  from f join p on p.channel = f.channel and cast(p.uid as varchar) = f.fwd and f.pos > p.put_pos
  where f.method = 'POST'),
r as (select * from c where n = 1),
t as (
  select p.*, g.get_id, g.get_ts, g.get_pos, r.post_id, r.post_ts, r.post_pos,
    case when g.get_id is null then null when r.post_pos < g.get_pos then 503 else 200 end as get_status
  from p left join g using (channel, seq) left join r using (channel, seq)),
fl as (
  select f.*, tg.get_status, tp.seq as put_seq, tp.uid as put_uid, coalesce(tp.get_pos < f.pos, false) as cleared
  from f left join t tg on tg.get_id = f.event_id left join t tp on tp.post_id = f.event_id),
replay as (
  select *,
    case when method = 'PUT' then 202
         when method = 'GET' then coalesce(get_status, 204)
         when method = 'POST' then case when fwd is null or fwd = 'bad' then 400 when put_seq is null then 300 else 200 end
         when method = 'HEAD' then case when depth > 0 then 200 else 204 end
         else 405 end as status,
    depth as q,
    cast(pops - sum(case when cleared then 1 else 0 end) over o as bigint) as pend,
    cast(puts - sum(case when put_seq is not null then 1 else 0 end) over o as bigint) as msgs
  from fl window o as (partition by channel order by pos rows between unbounded preceding and current row))
"""

_TELE = _LOG + """,
tele as (
  select channel, uid, epoch_us(put_ts) as created_at, epoch_us(put_ts) + put_k * 10 as reading_at,
    case when get_status = 200 then epoch_us(get_ts) end as emplaced_at,
    epoch_us(post_ts) as extracted_at, epoch_us(post_ts) + put_k as finished_at
  from t)
"""

_CONFIG = """
cfg as (
  select distinct user_id as channel, cast(3 as bigint) as limit_size,
    case when user_id % 5 = 0 then 0 else 1 + user_id % 3 end as limit_tasks,
    case user_id % 4 when 0 then 86400 when 1 then 174600 when 2 then 0 else 259265 end as period,
    1 + user_id % 3 as max_requests, user_id % 7 <> 0 as active,
    case when user_id % 3 = 0 then 'SyncSAPI' else 'SyncQueue' end as mq_class
  from events)
"""

_CRLF = "chr(13) || chr(10)"
_RAW = f"""
raw_http as (
  select event_id, user_id as channel,
    case event_type when 'signup' then 'PUT' when 'purchase' then 'put' when 'click' then 'GET' when 'view' then 'BREW' else 'POST' end
    || ' /ch/' || user_id || '?k=1 HTTP/1.1' || {_CRLF} || 'Host: a.example' || {_CRLF}
    || 'content-type: application/json' || {_CRLF} || 'X-Msg-Forward-Uid: ' || event_id || {_CRLF}
    || case when event_type = 'error' and event_id % 5 = 0 then '' else {_CRLF} end || props as raw
  from events),
cut as (
  select *, nullif(upper(regexp_extract(raw, '^(?i:(GET|POST|PUT|HEAD|OPTIONS|DELETE|TRACE|CONNECT|PATCH)) ', 1)), '') as method,
    instr(raw, {_CRLF} || {_CRLF}) as sep
  from raw_http),
parsed as (
  select *, case when method is null then 405 when sep = 0 then 431 else 0 end as code,
    regexp_extract(raw, '^[^ ]+ ([^ ]*)', 1) as target
  from cut)
"""

_ROUTES = r"""
paths as (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path from pages),
routes(channel, seg, spec, rx) as (values
  ('en-all', 'en', 4, '^(?:$|/(?:$|e(?:$|n(?:$|/.*))))'),
  ('en-35', 'en', 7, '^(?:$|/(?:$|e(?:$|n(?:$|/(?:$|3(?:$|5(?:$|/.*)))))))'),
  ('fr-seg', 'fr', 4, '^(?:$|/(?:$|f(?:$|r(?:$|/(?:$|[^/]*(?:$|/.*))))))'),
  ('de-83', 'de', 7, '^(?:$|/(?:$|d(?:$|e(?:$|/(?:$|8(?:$|3(?:$|/.*)))))))'),
  ('es-root', 'es', 4, '^(?:$|/(?:$|e(?:$|s(?:$|/.*))))'),
  ('any', '*', 1, '^/')),
ranked as (
  select p.page_id, p.path, r.channel,
    row_number() over (partition by p.page_id order by r.spec desc, r.channel desc) as n
  from paths p left join routes r
    on regexp_extract(p.path, '^/?([^/]*)', 1) = r.seg and regexp_matches(p.path, r.rx)),
matched as (select page_id, path, channel as route, case when channel is null then 404 else 200 end as status from ranked where n = 1)
"""

_TRACE = f"with {_LOG} select channel, seq, uid, put_id, get_id, get_status, post_id from t"
_DEPTH = f"with {_MESSAGES} select event_id, channel, pos, puts, depth, popped, pops from walk"
_REPLAY = f"with {_LOG} select event_id, method, status, q, pend, msgs from replay"

_BOUNDED = f"""
with recursive {_MESSAGES},
ops as (
  select event_id, channel, method, row_number() over (partition by channel order by ts, event_id) as n
  from m where method in ('PUT', 'GET')),
step as (
  select event_id, channel, method, n, 202 as status, cast(0 as bigint) as q from ops where false
  union all
  select channel, channel, '', cast(0 as bigint), 0, cast(0 as bigint) from (select distinct channel from ops)
  union all
  select o.event_id, o.channel, o.method, o.n,
    case when o.method = 'PUT' then case when s.q < 3 then 202 else 507 end
         else case when s.q > 0 then 200 else 204 end end,
    case when o.method = 'PUT' then least(3, s.q + 1) else greatest(0, s.q - 1) end
  from step s join ops o on o.channel = s.channel and o.n = s.n + 1)
select event_id, channel, method, status, q, case when status = 507 then 3 end as queue_limit from step where n > 0
"""

# The recursion decides which PUTs are refused; the replay is then that of the other rows. It starts from ``ops``, the rows
# of queues with their place ``pos`` in the channel and its limit ``lim`` (9e18: none).
_BOUNDED_STEPS = """
step as (
  select channel, cast(0 as bigint) as pos, cast(0 as bigint) as q, false as refused from (select distinct channel from ops)
  union all
  select o.channel, o.pos,
    case when o.method = 'PUT' then least(o.lim, s.q + 1) when o.method = 'GET' then greatest(0, s.q - 1) else s.q end,
    o.method = 'PUT' and s.q >= o.lim
  from step s join ops o on o.channel = s.channel and o.pos = s.pos + 1),
a as (
  select o.event_id, o.channel, o.pos, o.ts, o.uid, o.fwd, o.lim, o.method as asked, s.refused,
    case when s.refused then 'none' else o.method end as method, s.q as depth
  from ops o join step s on s.channel = o.channel and s.pos = o.pos),
b as (
  select *, sum(case when method = 'PUT' then 1 else 0 end) over o as puts,
    sum(case when method = 'PUT' then 1 else 0 end) over o - depth as pops
  from a window o as (partition by channel order by pos rows between unbounded preceding and current row)),
bw as (select *, method = 'GET' and pops > coalesce(lag(pops) over (partition by channel order by pos), 0) as popped from b),
bp as (select channel, puts as seq, uid, event_id as put_id, ts as put_ts, pos as put_pos from bw where method = 'PUT'),
bg as (select channel, pops as seq, event_id as get_id, ts as get_ts, pos as get_pos from bw where popped),
bc as (
  select w.channel, p.seq, w.event_id as post_id, w.ts as post_ts, w.uid as post_uid, w.pos as post_pos,
    row_number() over (partition by w.channel, p.seq order by w.pos) as n
  from bw w join bp p on p.channel = w.channel and cast(p.uid as varchar) = w.fwd and w.pos > p.put_pos where w.method = 'POST'),
bt as (
  select p.*, g.get_id, g.get_ts, g.get_pos, c.post_id, c.post_ts, c.post_uid, c.post_pos from bp p left join bg g using (channel, seq)
  left join (select * from bc where n = 1) c using (channel, seq)),
bl as (
  select w.*, tg.post_pos < tg.get_pos as late, tg.uid as got_uid, tg.put_id as got_id, tp.seq as put_seq, tp.put_id as answered_id,
    coalesce(tp.get_pos < w.pos, false) as cleared
  from bw w left join bt tg on tg.channel = w.channel and tg.get_pos = w.pos
  left join bt tp on tp.channel = w.channel and tp.post_pos = w.pos),
replayed as (
  select event_id, channel, asked as method, ts, uid, fwd, pops, cleared, answered_id, got_uid, got_id,
    case when refused then 507 when asked = 'PUT' then 202
         when asked = 'GET' then case when not popped then 204 when late then 503 else 200 end
         when asked = 'POST' then case when fwd is null or fwd = 'bad' then 400 when put_seq is null then 300 else 200 end
         when asked = 'HEAD' then case when depth > 0 then 200 else 204 end
         when asked = 'OPTIONS' then 200 else 405 end as status,
    cast(depth as bigint) as q,
    cast(pops - sum(case when cleared then 1 else 0 end) over o as bigint) as pend,
    cast(puts - sum(case when put_seq is not null then 1 else 0 end) over o as bigint) as msgs,
    case when refused then cast(lim as bigint) end as x_mq_queue_limit
  from bl window o as (partition by channel order by pos rows between unbounded preceding and current row))
"""

_BOUNDED_FULL = f"""
with recursive {_LOG},
ops as (
  select *, case channel % 4 when 0 then 9000000000000000000 when 1 then 1 when 2 then 3 else 5 end as lim from fl),
{_BOUNDED_STEPS}
select event_id, method, status, q, pend, msgs, x_mq_queue_limit from replayed
"""


def _scripted(kind: str, k: str, content: str) -> tuple[str, str, str]:
    """Status, reply and error of the sample scripts."""
    fails, mute = f"({kind} = 'PythonEngine' and {k} % 25 = 0)", f"({kind} = 'PythonEngine' and {k} % 10 = 7)"
    none = f"{kind} is null"
    return (
        f"case when {none} or {fails} or {mute} then 503 else 200 end",
        f"case when {none} or {fails} or {mute} then 'SAPI Endpoint error' when {kind} = 'PythonEngine' then cast({k} * 2 as varchar) else {content} end",
        f"case when {fails} then 'no multiples of 25: ' || {k} end",
    )


_S = _scripted("sapi", "k", """'{"k": ' || k || '}'""")
_BY_CLASS = f"""
with recursive {_LOG}, {_CONFIG},
ops as (
  select fl.*, cast(3 as bigint) as lim from fl join cfg using (channel) where mq_class = 'SyncQueue'),
{_BOUNDED_STEPS},
asked as (
  select m.*, active, case when channel % 6 = 0 then 'PythonEngine' when channel % 9 = 0 then 'PhpEngine' end as sapi,
    sum(case when method = 'PUT' and active then 1 else 0 end)
      over (partition by channel, sec // 86400 order by ts, event_id rows between unbounded preceding and current row) as n
  from m join cfg using (channel) where mq_class = 'SyncSAPI'),
done as (select *, case when method <> 'PUT' then 405 when not active then 521 when n > 3 then 507 end as own from asked)
select event_id, channel, 'SyncQueue' as mq_class, method, status, q, pend, msgs, x_mq_queue_limit,
  cast(null as varchar) as reply, cast(null as varchar) as error
from replayed
union all
select event_id, channel, 'SyncSAPI', method, coalesce(own, {_S[0]}), null, null, null, case when own = 507 then 3 end,
  case when own is null then {_S[1]} end, case when own is null then {_S[2]} end
from done
"""

# Answers of the exchange: what cannot be read, what has no channel, handler channels, queues.
_TELEGRAM = "'created-at=' || {0} || coalesce(';emplaced-at=' || {1}, '') || coalesce(';extracted-at=' || {2}, '') || ';finished-at=' || {3}"
_EXCHANGE = rf"""
with recursive {_LOG},
told as (
  select event_id, ts, ':8080' as listener, sec, uid as own_uid, fwd, k, channel as ch,
    case when event_id % 53 = 0 then 'OPTIONS' else method end as verb,
    case when event_id % 61 = 0 then 408 when event_id % 47 = 0 then 400 when event_id % 41 = 0 then 405 when event_id % 43 = 0 then 431 end as refusal,
    case when event_id % 59 <> 0 and channel % 11 <> 0 then 'ch-' || channel end as route,
    case when channel % 3 = 0 then 'SyncSAPI' else 'SyncQueue' end as cls,
    case when channel % 6 = 0 then 'PythonEngine' when channel % 3 = 0 then 'PhpEngine' end as sapi,
    case channel % 4 when 0 then 0 when 1 then 1 when 2 then 3 else 5 end as lim0, channel % 7 <> 0 as active,
    '{{"k": ' || k || '}}' as content, 'application/json' as kind
  from f),
{_ROUTES.strip().removesuffix(",")},
paged as (
  select p.page_id + 1000000000 as event_id, timestamp '2024-02-01' + to_seconds(p.page_id) as ts, ':8081' as listener,
    case p.page_id % 3 when 0 then 'PUT' when 1 then 'GET' else 'HEAD' end as verb,
    case when regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) = '' then 400 end as refusal, m.route, url as content
  from pages p join matched m using (page_id)),
read as (
  select event_id, ts, listener, own_uid as uid, fwd, k, verb, refusal, route, cls, sapi, lim0, active, content, kind, sec from told
  union all
  select event_id, ts, listener, ((epoch_us(ts) // 1000000) << 32) | event_id, null, null, verb, refusal, route, 'SyncQueue', null, 0, true, content,
    'text/uri-list', epoch_us(ts) // 1000000 from paged),
ops as (
  select event_id, route as channel, ts, verb as method, uid, fwd, row_number() over (partition by route order by ts, event_id) as pos,
    case when lim0 = 0 then 9000000000000000000 else lim0 end as lim
  from read where refusal is null and route is not null and cls = 'SyncQueue'),
{_BOUNDED_STEPS},
asked as (
  select *, sum(case when verb = 'PUT' and active then 1 else 0 end)
      over (partition by route, sec // 86400 order by ts, event_id rows between unbounded preceding and current row) as n
  from read where refusal is null and route is not null and cls = 'SyncSAPI'),
done as (
  select *, case when verb <> 'PUT' then 405 when not active then 521 when lim0 > 0 and n > lim0 then 507 end as own,
    {_S[0]} as s_code, {_S[1].replace("'SAPI", "'SAPI")} as s_reply, {_S[2]} as s_error from asked),
heads as (
  select r.event_id, bp.uid as head_uid from replayed r join bp on bp.channel = r.channel and bp.seq = r.pops + 1
  where r.method = 'HEAD' and r.status = 200),
waits as (
  select r.*, t.post_id, t.post_uid, t.post_ts, t.get_ts, t.get_pos, t.post_pos, h.head_uid
  from replayed r left join bt t on r.method = 'PUT' and r.status = 202 and t.put_id = r.event_id left join heads h on h.event_id = r.event_id)
select x.event_id, x.listener, null as channel, 'unparsed' as lane, x.refusal as code,
  case x.refusal when 400 then 'Bad Request' when 405 then 'Method Not Allowed' when 408 then 'Request Timeout' else 'Request Header Fields Too Large' end as message,
  '' as body, 'application/json' as content_type, null as allow, x.uid as x_msg_uid, null as x_msg_forward_uid, null as x_msg_head_uid,
  null as x_mq_class, null as x_mq_queue_count, null as x_mq_pending_count, null as x_mq_messages_count, null as x_mq_queue_limit,
  {_TELEGRAM.format("epoch_us(x.ts)", "null", "null", "epoch_us(x.ts)")} as telemetry
from read x where refusal is not null
union all
select event_id, listener, null, 'unrouted', 404, 'Endpoint not found', '', 'application/json', null, uid, null, null, null, null, null, null, null,
  {_TELEGRAM.format("epoch_us(ts)", "null", "null", "epoch_us(ts)")}
from read where refusal is null and route is null
union all
select event_id, listener, route, 'handler', coalesce(own, s_code),
  case own when 405 then 'Method ' || verb || ' Not Allowed' when 521 then 'SyncQueue is down pending' when 507 then 'Insufficient Storage'
    else case when s_code = 200 then 'OK' else 'SAPI Endpoint error' end end,
  case when own is not null then '' when s_code = 200 then s_reply else coalesce(s_error, '') end, 'application/json',
  case when own = 405 then 'PUT' end, uid, null, null, 'Sync.MQ.SAPI', null, null, null, case when own = 507 then lim0 end,
  {_TELEGRAM.format("epoch_us(ts)", "null", "null", "epoch_us(ts)")}
from done
union all
select w.event_id, x.listener, w.channel, 'queue', case when w.post_id is not null then 200 else w.status end,
  case when w.post_id is not null then 'OK'
    when w.status = 405 then 'Method ' || w.method || ' Not Allowed'
    when w.status = 400 and w.fwd is null then 'Bad Request. Header `X-MSG-FORWARD-UID` not found'
    when w.status = 400 then 'Bad Request. Invalid `X-MSG-FORWARD-UID` header'
    when w.status = 200 then 'OK' when w.status = 202 then 'Accepted' when w.status = 204 then 'Queue is empty'
    when w.status = 300 then 'Multiple Replays. Reply Ignored.' when w.status = 503 then 'Server.Std.Exception' else 'Insufficient Storage' end,
  case when w.post_id is not null then o.content when w.method = 'GET' and w.status = 200 then g.content when w.method = 'OPTIONS' then '$HELP' else '' end,
  case when w.post_id is not null then o.kind when w.method = 'GET' and w.status = 200 then g.kind when w.method = 'OPTIONS' then 'text/plain' else 'application/json' end,
  case when w.status = 405 then 'PUT,GET,POST,HEAD,OPTIONS' end, w.uid,
  case when w.post_id is not null then w.post_uid when w.method = 'GET' and w.status = 200 then w.got_uid end, w.head_uid,
  'Sync.MQ.Queue', coalesce(a.q, w.q), case when a.event_id is not null then a.pend + case when a.cleared then 1 else 0 end else w.pend end,
  case when a.event_id is not null then a.msgs + 1 else w.msgs end, w.x_mq_queue_limit,
  {_TELEGRAM.format("epoch_us(w.ts)", "case when w.get_pos < w.post_pos then epoch_us(w.get_ts) end", "epoch_us(w.post_ts)", "epoch_us(coalesce(w.post_ts, w.ts))")}
from waits w join read x on x.event_id = w.event_id left join read o on o.event_id = w.post_id left join read g on g.event_id = w.got_id
  left join replayed a on a.event_id = w.post_id
""".replace("$HELP", HELP_TEXT.replace("'", "''"))

_RATE = f"""
with {_MESSAGES}, {_CONFIG},
b as (select m.*, max_requests, case when period > 0 then sec // period end as bucket from m join cfg using (channel)),
n as (select *, row_number() over (partition by channel, bucket order by ts, event_id) as request_no from b)
select event_id, channel, bucket, request_no, bucket is not null and request_no > max_requests as over_limit from n
"""

_DAILY = f"""
with {_MESSAGES}, d as (select date_trunc('day', ts) as start, channel, method from m)
select epoch_us(start) as start_us, epoch_us(start + interval 1 day) as end_us, channel, method, count(*) as requests
from d group by all
"""

_LATENCY = ", ".join(
    f"count({s}) as {s}_n, min({s}) as {s}_min, max({s}) as {s}_max, cast(sum({s}) as bigint) as {s}_sum, "
    f"quantile_disc({s}, 0.5) as {s}_p50, quantile_disc({s}, 0.95) as {s}_p95"
    for s in ("wait", "service", "total")
)

_INTERVAL_EDGES = _LOG + """,
edges as (
  select channel, put_ts as ts, put_id as event_id, 1 as step from t
  union all select channel, post_ts, post_id, -1 from t where post_id is not null),
active as (
  select *, cast(sum(step) over (partition by channel order by ts, event_id rows between unbounded preceding and current row) as bigint) as active
  from edges)
"""

_HANDLED = """
case when length(text) % 10 = 0 then 503 else 200 end as status,
case when length(text) % 10 = 0 then 'SAPI Endpoint error' else role || ':' || length(text) end as reply
"""
_WORDS = "cast(length(text) - length(replace(text, ' ', '')) as varchar)"

_TEXT = """case
  when status = 405 then 'Method ' || method || ' Not Allowed'
  when status = 400 and fwd is null then 'Bad Request. Header `X-MSG-FORWARD-UID` not found'
  when status = 400 then 'Bad Request. Invalid `X-MSG-FORWARD-UID` header'
  when status = 200 then 'OK' when status = 202 then 'Accepted' when status = 204 then 'Queue is empty'
  when status = 300 then 'Multiple Replays. Reply Ignored.' when status = 503 then 'Server.Std.Exception' end"""

ORACLE: dict[str, str] = {
    "messages": f"""
        with {_MESSAGES} select event_id, epoch_us(ts) as ts_us, channel, method,
          list_position(['GET','POST','PUT','HEAD','OPTIONS','DELETE','TRACE','CONNECT','PATCH'], method) as ordinal, k, uid from m""",
    "union_listeners": f"""
        with {_RAW},
        pg as (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) as target, html from pages)
        select ':8080' as listener, event_id, code, method,
          case when code = 0 then split_part(target, '?', 1) end as uri,
          case when code = 0 then strlen(substr(raw, sep + 4)) end as body_bytes from parsed
        union all
        select ':8081', page_id, case when target = '' then 400 else 0 end, 'GET',
          case when target <> '' then split_part(target, '?', 1) end,
          case when target <> '' then strlen(html) end from pg""",
    "parse_http": f"""
        with {_RAW} select event_id, code, method,
          case when code = 0 then split_part(target, '?', 1) end as uri,
          case when code = 0 then split_part(target, '?', 2) end as params,
          case when code = 0 then cast(event_id as varchar) end as fwd,
          case when code = 0 then substr(raw, sep + 4) end as content from parsed""",
    "size_limits": f"""
        with {_RAW},
        lim as (select *, case when channel % 2 = 0 then 'main' else 'edge' end as listener,
          case when channel % 2 = 0 then 1048576 else 108 end as ql, case when channel % 2 = 0 then 8192 else 102 end as hl from parsed),
        coded as (select *, case when code = 0 and sep + 3 > least(ql, hl) then 431 else code end as c2 from lim)
        select event_id, listener, c2 as code,
          case when c2 = 0 then substr(substr(raw, 1, ql), sep + 4) end as content from coded""",
    "reply_log": f"""
        with {_LOG},
        looked as (
          select r.*, case when method = 'GET' and status = 200 then pops when method = 'HEAD' and status = 200 then pops + 1 end as look
          from replay r where method <> 'PUT'),
        own as (
          select l.event_id, l.channel, status as code, 'sender' as "to", {_TEXT} as message,
            case when method = 'GET' and status = 200 then '{{"k": ' || p.put_k || '}}' else '' end as body,
            'application/json' as content_type, case when status = 405 then 'PUT,GET,POST,HEAD,OPTIONS' end as allow, l.uid as x_msg_uid,
            case when method = 'GET' then p.uid end as x_msg_forward_uid,
            case when method = 'HEAD' then p.uid end as x_msg_head_uid,
            pend as x_mq_pending_count, msgs as x_mq_messages_count, 'Sync.MQ.Queue' as x_mq_class, q as x_mq_queue_count,
            cast(null as bigint) as x_mq_queue_limit,
            {_TELEGRAM.format("epoch_us(l.ts)", "null", "null", "epoch_us(l.ts)")} as telemetry
          from looked l left join p on p.channel = l.channel and p.seq = l.look)
        select * from own
        union all
        select r.event_id, r.channel, 200, 'caller', 'OK', '{{"k": ' || r.k || '}}', 'application/json', null, put_uid, r.uid, null,
          pend + case when cleared then 1 else 0 end, msgs + 1, 'Sync.MQ.Queue', q, null,
          {_TELEGRAM.format("epoch_us(t.put_ts)", "case when t.get_pos < t.post_pos then epoch_us(t.get_ts) end", "epoch_us(t.post_ts)", "epoch_us(t.post_ts)")}
        from replay r join t on t.post_id = r.event_id where method = 'POST' and status = 200""",
    "access_log": f"""
        with {_LOG} select uid, '192.168.1.' || (channel % 256) as address, 1024 + k as port, status as code, {_TEXT} as message,
          case when k % 2 = 0 then lower(to_hex(k)) end as thread
        from replay""",
    "snapshot_restore": f"{_REPLAY} where ts >= timestamp '2024-01-15 00:00:00'",
    "channel_table": r"""
        with d as (
          select c_name as channel, c_custkey % 9 as n, c_custkey as x from customer)
        select channel,
          case n when 0 then 'SyncQueue' when 1 then 'SyncQueue' when 2 then 'SyncSAPI' when 5 then 'SyncQueue'
            when 6 then 'SyncSAPI' when 7 then 'SyncSAPI' when 8 then 'SyncQueue' end as mq_class,
          case n when 2 then 'PythonEngine' when 7 then 'PythonEngine' end as sapi_class,
          case n when 0 then '/sms-' || x || '/*/' when 1 then '/orders-' || x || '/' when 2 then '/script-' || x || '/' end as uri,
          case n when 3 then 'invalid_endpoint' when 4 then 'mq_not_found' when 5 then 'invalid_sapi' when 6 then 'init_failed'
            when 7 then 'init_failed' when 8 then 'invalid_pattern' else 'ok' end as status
        from d""",
    "msg_uid": f"""
        with {_MESSAGES} select event_id, uid as given_uid,
          (cast(sec as bigint) << 32) | (row_number() over (partition by channel % 4 order by ts, event_id) - 1) as counted_uid from m""",
    "msg_uid_decode": f"with {_MESSAGES} select event_id, cast(sec as bigint) as second, event_id as counter from m",
    "quarantine": f"with {_RAW} select event_id, code, method, length(raw) as raw_chars from parsed where code <> 0",
    "header_lookup": f"""
        with {_RAW} select event_id, 'a.example' as host, 'application/json' as content_type, '*/*' as accept, 4 as n_headers
        from parsed where code = 0""",
    "uri_params": """
        with u as (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path,
          nullif(regexp_extract(url, '\\?([^#]*)', 1), '') as query from pages)
        select page_id, path, query,
          nullif(regexp_extract(query, '(?:^|&)utm_source=([^&]*)', 1), '') as utm_source,
          nullif(regexp_extract(query, '(?:^|&)page=([^&]*)', 1), '') as page,
          nullif(regexp_extract(query, '(?:^|&)ref=([^&]*)', 1), '') as ref from u""".replace("\\\\", "\\"),
    "method_policy": f"""
        with {_MESSAGES},
        c as (select *, case when channel % 3 = 0 then 'SyncSAPI' else 'SyncQueue' end as mq_class from m),
        d as (select *, case when mq_class = 'SyncSAPI' then method <> 'PUT' else method not in ('PUT','GET','POST','HEAD','OPTIONS') end as refused from c)
        select event_id, mq_class, method, case when refused then 405 else 0 end as code,
          case when refused then case when mq_class = 'SyncSAPI' or method = 'TRACE' then 'PUT' else 'PUT,GET,POST,HEAD,OPTIONS' end end as allow,
          case when refused then 'Method ' || method || ' Not Allowed' end as message from d""",
    "method_dispatch": f"""
        with {_MESSAGES} select event_id, method,
          case method when 'GET' then 1 when 'POST' then 2 when 'PUT' then 3 when 'HEAD' then 4 when 'DELETE' then 6 end as ordinal,
          case method when 'GET' then 'consume' when 'POST' then 'reply' when 'PUT' then 'enqueue' when 'HEAD' then 'peek' else 'refuse' end as op
        from m""",
    "route_match": f"with {_ROUTES} select page_id, path, route, status from matched",
    "route_miss": f"""
        with {_ROUTES} select page_id, path, status,
          '<Router.Runtime.Warning> Route `' || path || '` not found. [MSG: ' || page_id || ', 10.0.0.1:8080]' as line
        from matched where status = 404""",
    "fifo_consume": f"with {_MESSAGES} select channel, seq, uid, put_id, get_id from p join g using (channel, seq)",
    "reply_correlate": f"with {_LOG} select event_id, channel, fwd, put_seq, status from replay where method = 'POST'",
    "in_flight": f"with {_LOG} select channel, seq, uid, put_id, get_id from t where get_id is not null and post_id is null",
    "waiting": f"with {_MESSAGES} select channel, seq, uid, put_id from p left join g using (channel, seq) where get_id is null",
    "message_trace": _TRACE,
    "message_trace_sliced": _TRACE,
    "asof_state": f"""
        with {_LOG},
        span as (select date_trunc('day', min(ts)) + interval 1 day as a, date_trunc('day', max(ts)) + interval 2 day as b from events),
        probes as (select channel, unnest(range(a::timestamp, b::timestamp, interval 1 day)) as probe_ts
          from (select distinct user_id as channel from events), span),
        hit as (select p.channel, p.probe_ts, r.q, r.pend, r.msgs from probes p
          asof left join replay r on r.channel = p.channel and r.ts <= p.probe_ts)
        select channel, epoch_us(probe_ts) as probe_us, coalesce(q, 0) as waiting, coalesce(pend, 0) as pending,
          coalesce(msgs, 0) as messages from hit""",
    "queue_stats": f"""
        with {_LOG} select channel, max_by(q, pos) as waiting, max_by(pend, pos) as pending, max_by(msgs, pos) as messages,
          max(pos) as operations from replay group by channel""",
    "traffic_stats": f"with {_LOG} select channel, method, status, count(*) as requests from replay group by all",
    "latency_stats": f"""
        with {_TELE}, st as (select channel, emplaced_at - created_at as wait, extracted_at - emplaced_at as service,
          finished_at - created_at as total from tele)
        select channel, {_LATENCY} from st group by channel""",
    "latency_stats_narrowed": f"""
        with {_TELE}, st as (select channel, emplaced_at - created_at as wait, extracted_at - emplaced_at as service,
          finished_at - created_at as total from tele)
        select channel, {_LATENCY} from st group by channel""",
    "traffic_rollup": f"""
        with {_MESSAGES} select channel, method, epoch_us(date_trunc('day', ts)) as start_us, count(*) as requests, count(k) as measured,
          cast(sum(k) as bigint) as total, cast(min(k) as bigint) as least, cast(max(k) as bigint) as greatest from m group by all""",
    "dedupe": f"""
        with {_MESSAGES}, x as (select event_id, method, (channel << 32) | k as uid,
          row_number() over (partition by (channel << 32) | k order by ts, event_id) as n from m)
        select uid, event_id, method from x where n = 1""",
    "dedupe_history": f"""
        with {_MESSAGES}, x as (select event_id, method, (channel << 32) | k as uid,
          row_number() over (partition by (channel << 32) | k order by ts, event_id) as n from m)
        select uid, event_id, method from x where n = 1""",
    "peak_concurrency": f"with {_INTERVAL_EDGES} select channel, max(active) as peak from active group by channel",
    "queue_depth": _DEPTH,
    "queue_depth_sliced": _DEPTH,
    "queue_replay": _REPLAY,
    "queue_replay_sliced": _REPLAY,
    "queue_head": f"""
        with {_MESSAGES} select w.event_id, w.channel, p.uid as head_uid, case when p.uid is null then 204 else 200 end as status
        from walk w left join p on p.channel = w.channel and w.depth > 0 and p.seq = w.pops + 1 where w.method = 'HEAD'""",
    "queue_top": f"""
        with {_MESSAGES}, x as (select channel, row_number() over (partition by channel order by seq) as rank, uid, put_id
          from p left join g using (channel, seq) where get_id is null)
        select * from x where rank <= 3""",
    "range_except": """
        with a as (
          select p_partkey, p_size % 4 as lo,
            case when p_size % 10 = 0 then range(0, 16)
                 else list_transform(list_concat(range(p_size, p_size + 7), [2]), lambda v: v % 16) end as listed
          from part)
        select p_partkey, array_to_string(list_sort(list_distinct(list_filter(listed, lambda v: v not in (3, lo, lo + 1)))), ',') as cores
        from a""",
    "scalar_functions": r"""
        select doc_id, source as trimmed, lang || '|' || source as trimmed_list, trim(source, 'aeiou') as trimmed_chars,
          upper(lang) as upper_lang, lower(lang) as lower_lang,
          case when text = '' then 0 else least(3, length(text) - length(replace(text, ' ', '')) + 1) end as n_parts,
          case when text = '' then null
               when length(text) - length(replace(text, ' ', '')) < 2 then split_part(text, ' ', -1)
               else substr(text, length(split_part(text, ' ', 1)) + length(split_part(text, ' ', 2)) + 3) end as last_part,
          lang || '+' || source as joined, '<' || lang || ':' || n_chars || '>' as formatted,
          true as same,
          case when starts_with(lower(lang), 'd') then 1 when starts_with(lower(lang), 'en') then 2 when starts_with(lower(lang), 'f') then 3 else 0 end as prefix_no,
          coalesce(least(nullif(instr(regexp_replace(text, 'the', 'the', 'gi'), 'the'), 0), nullif(instr(regexp_replace(text, 'de', 'de', 'gi'), 'de'), 0)), 0) as first_needle,
          coalesce(least(nullif(instr(text, '.'), 0), nullif(instr(text, ','), 0)), 0) as first_char,
          lang || '-q' as scheme, source as rest, lang as limit_option, 'none' as other_option
        from documents""",
    "parse_bytes": """
        with x as (select p_partkey, p_partkey % 7 as n, p_size from part)
        select p_partkey,
          case n when 6 then 'none' when 5 then '' else ' ' || p_size || case n when 0 then 'G' when 1 then ' M' when 2 then 'K' when 3 then 'B' else '' end end as text,
          case n when 6 then 8192 when 5 then 8192 else cast(p_size as bigint) * case n when 0 then 1073741824 when 1 then 1048576 when 2 then 1024 else 1 end end as bytes
        from x""",
    "parse_period": """
        with x as (select p_partkey, p_partkey % 5 as n, p_size from part)
        select p_partkey,
          case n when 0 then p_size || 'h 2m 3s' when 1 then p_size || 'm' when 2 then ' ' || p_size || ' s' when 3 then '' else 'x' || p_size || 'h' end as text,
          case n when 0 then p_size * 3600 + 123 when 1 then p_size * 60 when 2 then p_size else 0 end as seconds
        from x""",
    "expand_ranges": """
        with x as (select p_partkey, p_partkey % 4 as n, p_size as lo, p_size + 5 as hi from part)
        select p_partkey,
          case n when 0 then '2, ' || lo || ' - ' || hi when 1 then lo || '-' when 2 then '' else hi || ',1,' || hi end as text,
          array_to_string(list_sort(list_distinct(
            case n when 0 then list_concat([2], range(lo, hi + 1)) when 1 then [lo] when 2 then [] else [hi, 1] end)), ',') as numbers
        from x""",
    "format_ip": """
        with x as (select event_id, user_id, (event_id * 2654435761) % 4294967296 as w from events),
        h as (select *, lpad(to_hex(w), 8, '0') as a, lpad(to_hex(event_id), 8, '0') as b, lpad(to_hex(user_id), 8, '0') as c from x)
        select event_id, (w >> 24) || '.' || ((w >> 16) & 255) || '.' || ((w >> 8) & 255) || '.' || (w & 255) as ipv4,
          a[1:4] || ':' || a[5:8] || ':' || b[1:4] || ':' || b[5:8] || ':' || c[1:4] || ':' || c[5:8] || ':0000:0000' as ipv6
        from h""",
    "json_write": """
        select conv_id, turn, cast(to_json({'role': role, 'turn': turn, 'text': text}) as varchar) as as_object,
          cast(to_json([role, text]) as varchar) as as_array from conversations""",
    "telemetry_header": f"""
        with {_TELE} select uid, concat_ws(';', 'created-at=' || created_at, 'reading-at=' || reading_at, 'emplaced-at=' || emplaced_at,
          'extracted-at=' || extracted_at, 'finished-at=' || finished_at) as header, created_at, emplaced_at from tele""",
    "bounded_queue": _BOUNDED,
    "bounded_queue_chunked": _BOUNDED,
    "queue_replay_bounded": _BOUNDED_FULL,
    "queue_replay_bounded_sliced": _BOUNDED_FULL,
    "rate_limit": _RATE,
    "rate_limit_sliced": _RATE,
    "task_limit": f"""
        with {_INTERVAL_EDGES}, {_CONFIG}
        select event_id, channel, a.active, limit_tasks, limit_tasks > 0 and a.active > limit_tasks as over_limit
        from active a join cfg using (channel) where step = 1""",
    "endpoint_down": f"""
        with {_MESSAGES}, {_CONFIG} select event_id, channel, 521 as status from m join cfg using (channel)
          where not active and mq_class = 'SyncSAPI' and method = 'PUT' """,
    "handler_apply": f"select conv_id, turn, {_HANDLED} from conversations",
    "handler_by_channel": f"""
        select conv_id, turn, 'PythonEngine' as sapi_class, {_HANDLED} from conversations where role = 'user'
        union all select conv_id, turn, 'PhpEngine', 200, {_WORDS} from conversations where role = 'assistant'
        union all select conv_id, turn, 'none', 503, 'SAPI Endpoint error' from conversations where role not in ('user', 'assistant')""",
    "handler_chain": f"""
        select conv_id, turn, 200 as status, {_WORDS.replace('text', "trim(text)")} as reply from conversations where role = 'user'""",
    "queue_by_class": _BY_CLASS,
    "exchange": _EXCHANGE,
    "stream_messages": f"with {_MESSAGES} select event_id, channel, method, k, uid from m",
    "stream_route": f"with {_ROUTES} select page_id, path, route, status from matched",
    "stream_queue": _REPLAY,
    "stream_queue_batches": _REPLAY,
    "stream_dedupe": f"with {_MESSAGES} select distinct (channel << 32) | k as uid, channel, k from m",
    "stream_correlate": f"""
        with {_LOG} select p.channel as put_channel, p.put_id, p.uid as put_uid,
          arg_min(f.event_id, (f.ts, f.event_id)) as post_id
        from p left join f on f.method = 'POST' and f.channel = p.channel and f.fwd = cast(p.uid as varchar)
          and f.ts >= p.put_ts and f.ts <= p.put_ts + interval 3 day
        group by p.channel, p.put_id, p.uid""",
    "stream_monitor": _DAILY,
    "stream_monitor_sliding": f"""
        with {_MESSAGES}, d as (
          select date_trunc('day', ts) as start, channel, method from m
          union all select date_trunc('day', ts) - interval 1 day, channel, method from m)
        select epoch_us(start) as start_us, epoch_us(start + interval 2 day) as end_us, channel, method, count(*) as requests
        from d group by all""",
    "stream_sessions": f"""
        with {_MESSAGES},
        x as (select channel, ts, case when ts - lag(ts) over o >= interval 12 hour then 1 else 0 end as fresh
          from m window o as (partition by channel order by ts)),
        y as (select channel, ts, sum(fresh) over (partition by channel order by ts) as no from x)
        select epoch_us(min(ts)) as start_us, epoch_us(max(ts) + interval 12 hour) as end_us, channel, count(*) as requests
        from y group by channel, no""",
    "stream_replies": f"""
        with {_RAW} select event_id, case when code = 0 then 'accepted' else 'quarantined' end as lane, code, method,
          case when code = 0 then split_part(target, '?', 1) end as uri from parsed""",
    "stream_connections": f"""
        with {_RAW},
        kept as (select p.*, row_number() over (partition by p.channel, date_trunc('hour', e.ts) order by e.ts, event_id) - 1 as number
          from parsed p join events e using (event_id) where code <> 431)
        select event_id, number, code, method, case when code = 0 then split_part(target, '?', 1) end as uri,
          case when code = 0 then substr(raw, sep + 4) end as content from kept""",
    "stream_restart": _DAILY,
}
