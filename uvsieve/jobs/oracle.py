"""The same queries in SQL, for an engine of their own: common table expressions and a final select each.

Nothing here is shared with the DataFrame code; constants are written out again.
"""

from __future__ import annotations

import re

FACTOR = 0.2

#: The derivative of ln gamma at k.
_PSI = "(ln(k+10)-1/(2*(k+10))-1/(12*(k+10)**2)+1/(120*(k+10)**4)-1/(252*(k+10)**6)+1/(240*(k+10)**8)" + "".join(f"-1/(k+{i})" for i in range(10)) + ")"

#: Building blocks; each may use those before it.
BLOCKS = {
    "vis": """SELECT event_id*4+chan AS newrow, event_id, user_id, chan, lam, u_m, v_m, u_m/lam AS u, v_m/lam AS v,
        CASE WHEN event_id%41=0 THEN 0::DOUBLE
             WHEN event_type='error' AND chan=1 AND event_id%31 IN (3,4,5) THEN 6*sqrt(value)
             WHEN event_id%31 IN (20,21) AND (event_id*7)%29 IN (10,11) THEN 20*sqrt(value)
             WHEN event_id%701=0 THEN 300*sqrt(value) ELSE sqrt(value) END AS amp, event_id%23=0 AS flag
        FROM (SELECT *, ((event_id%31)-15)*30::DOUBLE+(user_id%15)*2 AS u_m, (((event_id*7)%29)-14)*30::DOUBLE+(user_id%13)*2 AS v_m,
                     299792458::DOUBLE/(1000000000::DOUBLE+100000000::DOUBLE*chan) AS lam
              FROM (SELECT e.*, c.chan FROM events e, (SELECT unnest(range(4)) AS chan) c) x) y""",
    "lim": "SELECT min(u_m)/min(lam) AS u_lo, max(u_m)/min(lam) AS u_hi, min(v_m)/min(lam) AS v_lo, max(v_m)/min(lam) AS v_hi, max(lam) AS lam_max, min(lam) AS lam_min FROM vis",
    "width": "SELECT *, trunc(1/(1.22::DOUBLE*lam_max/13.5::DOUBLE)) AS bw FROM lim",
    "spec": f"SELECT *, trunc({FACTOR}::DOUBLE*(u_hi-u_lo)/bw)::INTEGER AS u_n, trunc({FACTOR}::DOUBLE*(v_hi-v_lo)/bw)::INTEGER AS v_n FROM width",
    "edges": """SELECT *, list_append(list_transform(range(u_n-1), lambda i: u_lo+i*((u_hi-u_lo)/(u_n-1))), u_hi) AS ue,
        list_append(list_transform(range(v_n-1), lambda i: v_lo+i*((v_hi-v_lo)/(v_n-1))), v_hi) AS ve FROM spec""",
    "binned": "SELECT newrow, amp AS value, flag, u, v, len(list_filter(ue, lambda e: e<=u))::INTEGER AS u_bin, len(list_filter(ve, lambda e: e<=v))::INTEGER AS v_bin FROM vis, edges",
    "kept": "SELECT u_bin, v_bin, newrow, value FROM binned WHERE NOT flag AND value<>0",
    "stats": "SELECT u_bin, v_bin, count(*) AS n, avg(value) AS mean, median(value) AS median FROM kept GROUP BY ALL",
    "cells": """SELECT s.*, sqrt(a*a+b*b) AS radius FROM (SELECT stats.*, CASE WHEN u_bin=0 THEN ue[-1] ELSE ue[u_bin] END AS a, CASE WHEN v_bin=0 THEN ve[-1] ELSE ve[v_bin] END AS b FROM stats, edges) s""",
    "q": "SELECT quantile_cont(radius, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS e FROM cells WHERE median>0",
    "rings": "SELECT k::INTEGER AS annulus_id, CASE WHEN k=0 THEN 0::DOUBLE ELSE e[k] END AS r_lo, e[k+1] AS r_hi FROM q, (SELECT unnest(range(10)) AS k) x",
    "ringed": """SELECT c.*, r.annulus_id FROM cells c LEFT JOIN rings r ON c.median>0 AND round(c.radius,6)>round(r.r_lo,6) AND round(c.radius,6)<round(r.r_hi,6)""",
    "mid": "SELECT annulus_id, median(ln(median)) AS m, count(*) AS n_cells FROM ringed WHERE annulus_id IS NOT NULL GROUP BY 1",
    "limits": """SELECT r.annulus_id, any_value(m) AS m, any_value(n_cells) AS n_cells, exp(any_value(m)-3*1.4826*median(abs(ln(median)-m))) AS ci_lower, exp(any_value(m)+3*1.4826*median(abs(ln(median)-m))) AS ci_upper
        FROM ringed r JOIN mid USING (annulus_id) GROUP BY 1""",
    "known": """SELECT c.*, l.ci_upper AS cu, 0.5/n AS alpha, coalesce(median>l.ci_upper,false) OR coalesce(mean/nullif(median,0)>1.2,false) AS doubted
        FROM ringed c LEFT JOIN limits l ON l.annulus_id=coalesce(c.annulus_id,9)""",
    "low1": "SELECT u_bin, v_bin, value FROM kept JOIN known USING (u_bin,v_bin) WHERE doubted AND value < cu/sqrt(2*ln(2))*sqrt(-2*ln(alpha/2))",
    "st1": "SELECT u_bin, v_bin, count(*) AS n, avg(value) AS mean, median(value) AS median, list(value ORDER BY value) AS vals FROM low1 GROUP BY ALL",
    "clip": """SELECT u_bin, v_bin, vals, 0 AS it, true AS go FROM st1 WHERE mean/nullif(median,0)>1.4
        UNION ALL SELECT u_bin, v_bin, kept AS vals, it+1, len(kept)<len(vals) FROM (
          SELECT u_bin, v_bin, it, vals, list_filter(vals, lambda x: x>c-3*s AND x<c+3*s) AS kept FROM (
            SELECT *, sqrt(greatest(list_sum(list_transform(vals, lambda x: x*x))-len(vals)*c*c,0)/(len(vals)-1)) AS s FROM (SELECT *, list_avg(vals) AS c FROM clip WHERE go AND it<100 AND len(vals)>=2) a) b) d""",
    "allclip": """SELECT u_bin, v_bin, list(value ORDER BY value) AS vals, 0 AS it, true AS go FROM kept GROUP BY ALL
        UNION ALL SELECT u_bin, v_bin, kept1 AS vals, it+1, len(kept1)<len(vals) FROM (
          SELECT u_bin, v_bin, it, vals, list_filter(vals, lambda x: x>c-3*s AND x<c+3*s) AS kept1 FROM (
            SELECT *, sqrt(greatest(list_sum(list_transform(vals, lambda x: x*x))-len(vals)*c*c,0)/(len(vals)-1)) AS s FROM (SELECT *, list_avg(vals) AS c FROM allclip WHERE go AND it<100 AND len(vals)>=2) a) b) d""",
    # estimates by steps: shapes by bisection, the Weibull one over the values' centred logarithms
    "logs": "SELECT list(ln(value)) AS l, avg(ln(value)) AS m, stddev_pop(ln(value)) AS d, avg(value) AS mean FROM kept WHERE value>0",
    "weib": """SELECT 1e-2::DOUBLE AS lo, 50::DOUBLE AS hi, 0 AS it UNION ALL SELECT CASE WHEN s1/s0-1/k<0 THEN k ELSE lo END, CASE WHEN s1/s0-1/k<0 THEN hi ELSE k END, it+1 FROM (
        SELECT lo, hi, k, it, list_sum(list_transform(l, lambda x: exp(k*(x-m)))) AS s0, list_sum(list_transform(l, lambda x: exp(k*(x-m))*(x-m))) AS s1 FROM (SELECT lo, hi, it, sqrt(lo*hi) AS k FROM weib WHERE it<60) h, logs) w""",
    "weibull": "SELECT k AS shape, exp(m+ln(list_avg(list_transform(l, lambda x: exp(k*(x-m)))))/k) AS scale FROM (SELECT sqrt(lo*hi) AS k FROM weib WHERE it=60) b, logs",
    "halves": f"""SELECT 1e-3::DOUBLE AS lo, 1e3::DOUBLE AS hi, 0 AS it UNION ALL SELECT CASE WHEN ln(k)-{_PSI}>ln(mean)-m THEN k ELSE lo END, CASE WHEN ln(k)-{_PSI}>ln(mean)-m THEN hi ELSE k END, it+1
        FROM (SELECT lo, hi, it, sqrt(lo*hi) AS k FROM halves WHERE it<80) h, logs""",
    "gammas": "SELECT sqrt(lo*hi) AS shape, mean/sqrt(lo*hi) AS scale FROM halves, logs WHERE it=80",
    "closed": "SELECT avg(value) AS mean, stddev_pop(value) AS std, sqrt(avg(value*value)/2) AS sigma, avg(ln(value)) AS log_mean, stddev_pop(ln(value)) AS log_std FROM kept WHERE value>0",
    "medclip": """SELECT u_bin, v_bin, list(value ORDER BY value) AS vals, 0 AS it, true AS go FROM kept GROUP BY ALL
        UNION ALL SELECT u_bin, v_bin, kept2 AS vals, it+1, len(kept2)<len(vals) FROM (
          SELECT u_bin, v_bin, it, vals, list_filter(vals, lambda x: x>c-4*s AND x<c+3*s) AS kept2 FROM (
            SELECT *, sqrt(greatest(list_sum(list_transform(vals, lambda x: x*x))-len(vals)*c*c,0)/(len(vals)-1)) AS s FROM (SELECT *, list_median(vals) AS c FROM medclip WHERE go AND it<100 AND len(vals)>=2) a) b) d""",
    "medclipped": "SELECT u_bin, v_bin, arg_max(vals, it) AS vals FROM medclip GROUP BY ALL",
    "allclipped": "SELECT u_bin, v_bin, arg_max(vals, it) AS vals FROM allclip GROUP BY ALL",
    "clipped": "SELECT u_bin, v_bin, arg_max(vals, it) AS vals FROM clip GROUP BY ALL",
    "st2": """SELECT u_bin, v_bin, mean, median FROM st1 WHERE NOT coalesce(mean/nullif(median,0)>1.4,false)
        UNION ALL SELECT u_bin, v_bin, list_avg(vals), list_median(vals) FROM clipped WHERE len(vals)>0""",
    "thr": """SELECT u_bin, v_bin, CASE WHEN branch IN ('empty','dropped') THEN 0::DOUBLE ELSE med/sqrt(2*ln(2))*sqrt(-2*ln(1-alpha/2)) END AS lo,
        CASE WHEN branch IN ('empty','dropped') THEN 0::DOUBLE ELSE med/sqrt(2*ln(2))*sqrt(-2*ln(alpha/2)) END AS hi, branch FROM (
        SELECT k.u_bin, k.v_bin, k.alpha, CASE WHEN NOT doubted THEN k.median ELSE s.median END AS med,
          CASE WHEN NOT doubted THEN 'trusted' WHEN s.median IS NULL THEN 'empty' WHEN coalesce(s.median>cu,false) OR coalesce(s.mean/nullif(s.median,0)>1.4,false) THEN 'dropped' ELSE 'recovered' END AS branch
        FROM known k LEFT JOIN st2 s USING (u_bin,v_bin)) x""",
    "judged": "SELECT k.*, lo, hi, value<=lo OR value>=hi AS outlier FROM kept k JOIN thr USING (u_bin,v_bin)",
    "flags": "SELECT newrow, 'threshold' AS reason FROM judged WHERE outlier UNION ALL SELECT newrow, 'zero' FROM binned WHERE NOT flag AND value=0",
    # nested main table
    "nested": """SELECT event_id AS row_id, (user_id%5)::INTEGER AS field_id, (event_id%2)::INTEGER AS ddid, day(ts)::INTEGER AS scan_number, epoch_us(ts)/1000000::DOUBLE+40587*86400::DOUBLE AS time,
        CASE WHEN event_id%17=0 THEN -1 ELSE list_position(['click','error','purchase','signup','view'], event_type)-1 END::INTEGER AS state_id,
        ((event_id%31)-15)*30::DOUBLE+(user_id%15)*2 AS u_m, (((event_id*7)%29)-14)*30::DOUBLE+(user_id%13)*2 AS v_m, event_id, event_type, value, ts FROM events""",
    "spw": "SELECT * FROM (VALUES (0,[1.0e9,1.1e9,1.2e9,1.3e9]::DOUBLE[],1.0e8::DOUBLE,4.0e8::DOUBLE,'SPW0'),(1,[1.4e9,1.5e9]::DOUBLE[],1.0e8::DOUBLE,2.0e8::DOUBLE,'SPW1')) t(spw_id,chan_freq,chan_width,total_bandwidth,name)",
    "dd": "SELECT * FROM (VALUES (0,1),(1,0)) t(ddid,spw_id)",
    "bases": "SELECT ddid, nchan, n_rows, coalesce(sum(n_rows*nchan) OVER (ORDER BY ddid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS base FROM (SELECT ddid, len(chan_freq) AS nchan, count(*) AS n_rows FROM nested JOIN dd USING (ddid) JOIN spw USING (spw_id) GROUP BY ALL) x",
    "long": """SELECT base+row*nchan+chan AS newrow, ddid, row, chan, lam, u_m, v_m, u_m/lam AS u, v_m/lam AS v, event_id, amp, state_id, field_id,
        [event_id%23=0,false,event_id%29=0,event_id%37=0] AS fl FROM (
        SELECT *, 299792458::DOUBLE/chan_freq[chan+1] AS lam,
          CASE WHEN event_id%41=0 THEN 0::DOUBLE WHEN event_type='error' AND event_id%31 IN (3,4,5) AND chan=1 THEN 6*sqrt(value) WHEN event_id%31 IN (20,21) AND (event_id*7)%29 IN (10,11) THEN 20*sqrt(value)
               WHEN event_id%701=0 THEN 300*sqrt(value) ELSE sqrt(value) END AS amp FROM (
          SELECT n.*, b.nchan, b.base, w.chan_freq, row_number() OVER (PARTITION BY n.ddid ORDER BY row_id)-1 AS row, unnest(range(b.nchan))::INTEGER AS chan
          FROM nested n JOIN dd USING (ddid) JOIN spw w USING (spw_id) JOIN bases b ON b.ddid=n.ddid) x) y""",
    "lams": "SELECT min(299792458::DOUBLE/f) AS lam_min, max(299792458::DOUBLE/f) AS lam_max FROM (SELECT unnest(chan_freq) AS f FROM spw) x",
    "llim": "SELECT *, trunc(1/(1.22::DOUBLE*lam_max/13.5::DOUBLE)) AS bw FROM (SELECT min(u_m)/any_value(lam_min) AS u_lo, max(u_m)/any_value(lam_min) AS u_hi, min(v_m)/any_value(lam_min) AS v_lo, max(v_m)/any_value(lam_min) AS v_hi, any_value(lam_max) AS lam_max FROM nested, lams) x",
    "lspec": f"SELECT *, trunc({FACTOR}::DOUBLE*(u_hi-u_lo)/bw)::INTEGER AS u_n, trunc({FACTOR}::DOUBLE*(v_hi-v_lo)/bw)::INTEGER AS v_n FROM llim",
    "found_edges": """SELECT *, list_append(list_transform(range(u_n-1), lambda i: u_lo+i*((u_hi-u_lo)/(u_n-1))), u_hi) AS ue,
        list_append(list_transform(range(v_n-1), lambda i: v_lo+i*((v_hi-v_lo)/(v_n-1))), v_hi) AS ve FROM lspec""",
    "found_binned": """SELECT newrow, ddid, row, chan, (amp/2)::FLOAT::DOUBLE+(amp/2)::FLOAT::DOUBLE AS value, sqrt(pow((amp/2)::FLOAT::DOUBLE+(amp/2)::FLOAT::DOUBLE,2)+pow((amp/4)::FLOAT::DOUBLE+(amp/4)::FLOAT::DOUBLE,2)) AS strength,
        fl[1] OR fl[4] AS flag, u, v, len(list_filter(ue, lambda e: e<=u))::INTEGER AS u_bin, len(list_filter(ve, lambda e: e<=v))::INTEGER AS v_bin FROM long, found_edges""",
    "states": "SELECT * FROM (VALUES (0,'click'),(1,'error'),(2,'purchase'),(3,'signup'),(4,'view')) t(state_id,obs_mode)",
    "ant": "SELECT s_suppkey::INTEGER AS antenna_id, s_name AS name, 5109000.0::DOUBLE+(s_suppkey*37)%4001 AS x, 2006000.0::DOUBLE+(s_suppkey*53)%3001 AS y, -3239000.0::DOUBLE+floor(s_acctbal) AS z FROM supplier",
    "moments": "SELECT unnest(['begin','middle','end']) AS moment, unnest([min(time),(min(time)+max(time))/2,max(time)]) AS t FROM nested",
    "angles": """SELECT moment, radians(280.46061837::DOUBLE+360.98564736629::DOUBLE*d+0.000387933::DOUBLE*pow(d/36525,2)-pow(d/36525,3)/38710000::DOUBLE)+lon-0.2::DOUBLE AS h, -0.1::DOUBLE AS dec
        FROM (SELECT moment, t/86400-51544.5::DOUBLE AS d, lon FROM moments, (SELECT atan2(avg(y),avg(x)) AS lon FROM ant) l) q""",
    "turned": "SELECT moment, antenna_id, x*sin(h)+y*cos(h) AS u, -x*sin(dec)*cos(h)+y*sin(dec)*sin(h)+z*cos(dec) AS v FROM angles, ant",
    "mids": "SELECT u_bin, v_bin, median(value) AS m FROM kept GROUP BY ALL",
}


#: The steps from binned rows to flags, once more over the long rows of the nested table.
STEPS = ("kept", "stats", "cells", "q", "rings", "ringed", "mid", "limits", "known", "low1", "st1", "clip", "clipped", "st2", "thr", "judged", "flags")
_AGAIN = re.compile(rf"\b({'|'.join((*STEPS, 'binned', 'edges'))})\b")
BLOCKS |= {f"found_{step}": _AGAIN.sub(r"found_\1", BLOCKS[step]) for step in STEPS}


def sql(select: str) -> str:
    """``select`` under the blocks it needs."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in BLOCKS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(BLOCKS[name])

    need(select)
    recursive = "RECURSIVE " if needed & {"clip", "allclip", "medclip", "found_clip", "weib", "halves"} else ""
    parts = ", ".join(f"{n} AS ({b})" for n, b in BLOCKS.items() if n in needed)
    return f"WITH {recursive}{parts} {select}" if parts else select


R6 = lambda *c: ", ".join(f"round({x},6) AS {n}" for x, n in (y if isinstance(y, tuple) else (y, y) for y in c))

ORACLE_SQL: dict[str, str] = {
    "flag_visibilities": sql("SELECT newrow, reason FROM flags"),
    "flag_rows": sql(f"SELECT newrow, u_bin, v_bin, {R6('value', 'lo', 'hi')} FROM judged WHERE outlier"),
    "median_grid": sql(f"SELECT u_bin, v_bin, {R6('median')} FROM stats"),
    "median_grid_flagged": sql("SELECT c.u_bin, c.v_bin, round(coalesce(m,0),6) AS median FROM stats c LEFT JOIN (SELECT u_bin, v_bin, median(value) AS m FROM judged WHERE NOT outlier GROUP BY ALL) j USING (u_bin,v_bin)"),
    "flag_count_grid": sql("SELECT u_bin, v_bin, count_if(outlier)::BIGINT AS flagged FROM judged GROUP BY ALL"),
    "bin_thresholds": sql(f"SELECT u_bin, v_bin, {R6('lo', 'hi')}, branch FROM thr"),
    "grid_spec": sql(f"SELECT {R6('u_lo', 'u_hi', 'v_lo', 'v_hi', 'bw')}, u_n, v_n FROM spec"),
    "uv_limits": sql(f"SELECT {R6('u_lo', 'u_hi', 'v_lo', 'v_hi', ('lam_min', 'lam_min'), ('lam_max', 'lam_max'))} FROM lim"),
    "linspace_edges": sql("SELECT (unnest(range(u_n))+1)::INTEGER AS idx, round(unnest(ue),6) AS edge FROM edges"),
    "digitize": sql("SELECT newrow, u_bin, v_bin FROM binned"),
    "uv_distance": sql("SELECT newrow, round(sqrt(u*u+v*v),6) AS distance FROM vis"),
    "fov": sql("SELECT chan, round(max(1.22::DOUBLE*lam/13.5::DOUBLE),9) AS fov, round(max(lam),9) AS wavelength FROM vis GROUP BY chan"),
    "angular_resolution": sql("SELECT round(1/max(sqrt(u*u+v*v))*(180/pi())*3600,6) AS arcsec FROM vis"),
    "statistical_width": sql("SELECT round(stddev_pop(u)*3.5/pow(count(*),0.25),6) AS u_width, round(stddev_pop(v)*3.5/pow(count(*),0.25),6) AS v_width FROM vis"),
    "null_flags": sql("SELECT newrow FROM binned WHERE NOT flag AND value=0"),
    "sort_bins": sql("SELECT (row_number() OVER (ORDER BY u_bin,v_bin,newrow))::BIGINT AS place, newrow FROM kept"),
    "grid_row_map": sql("SELECT u_bin, v_bin, (sum(n) OVER (ORDER BY u_bin,v_bin)-n)::BIGINT AS start, (sum(n) OVER (ORDER BY u_bin,v_bin))::BIGINT AS stop FROM stats"),
    "mad_grid": sql("SELECT u_bin, v_bin, round(1.4826*median(abs(value-m)),6) AS mad FROM kept JOIN mids USING (u_bin,v_bin) GROUP BY ALL"),
    "rms_grid": sql("SELECT u_bin, v_bin, round(sqrt(sum(pow(value-m,2))),6) AS rms FROM kept JOIN mids USING (u_bin,v_bin) GROUP BY ALL"),
    "std_grid": sql("SELECT u_bin, v_bin, round(stddev_pop(value),6) AS std FROM kept GROUP BY ALL"),
    "cell_summary": sql("SELECT s.u_bin, s.v_bin, s.n, round(s.mean,6) AS mean, round(s.median,6) AS median, round(std,6) AS std, round(mad,6) AS mad, round(s.mean/s.median,6) AS ratio FROM stats s JOIN (SELECT u_bin, v_bin, stddev_pop(value) AS std, 1.4826*median(abs(value-m)) AS mad FROM kept JOIN mids USING (u_bin,v_bin) GROUP BY ALL) x USING (u_bin,v_bin)"),
    "cell_index_ranges": sql("SELECT u_bin, v_bin, min(newrow) AS first_row, max(newrow) AS last_row FROM kept GROUP BY ALL"),
    "group_indices": sql("SELECT u_bin, v_bin, row_number() OVER (PARTITION BY u_bin, v_bin ORDER BY newrow) AS place, newrow FROM kept"),
    "group_flagval": sql("SELECT u_bin, v_bin, row_number() OVER (PARTITION BY u_bin, v_bin ORDER BY newrow) AS place, newrow, flag FROM binned"),
    "distinct_bins": sql("SELECT count(DISTINCT u_bin) AS u_bins, count(DISTINCT v_bin) AS v_bins FROM binned"),
    "existing_flags": sql("SELECT count(*) AS n, count_if(flag)::BIGINT AS flagged, round(100.0::DOUBLE*count_if(flag)/count(*),6) AS percent FROM binned"),
    "flag_percentage": sql("SELECT (SELECT count(*) FROM flags) AS flagged, count(*) AS n, round(100.0::DOUBLE*(SELECT count(*) FROM flags)/count(*),6) AS percent FROM binned"),
    "remove_zero_values": sql("SELECT u_bin, v_bin, count_if(value>0)::BIGINT AS positive, count_if(value=0)::BIGINT AS zero FROM binned GROUP BY ALL"),
    "kd_partition_sizes": sql("""SELECT leaf, sum(n)::BIGINT AS n FROM (SELECT s.*, 2*l1.leaf+(s.v_bin>p2.pivot)::INTEGER AS leaf FROM stats s
        JOIN (SELECT u_bin, v_bin, (u_bin>(SELECT min(u_bin) FROM (SELECT u_bin, sum(sum(n)) OVER (ORDER BY u_bin) AS t FROM stats GROUP BY u_bin) a WHERE t*2>=(SELECT sum(n) FROM stats)))::INTEGER AS leaf FROM stats) l1 USING (u_bin,v_bin)
        JOIN (SELECT leaf, min(v_bin) AS pivot FROM (SELECT leaf, v_bin, sum(sum(n)) OVER (PARTITION BY leaf ORDER BY v_bin) AS t, sum(sum(n)) OVER (PARTITION BY leaf) AS w FROM (SELECT s.v_bin, s.n,
          (u_bin>(SELECT min(u_bin) FROM (SELECT u_bin, sum(sum(n)) OVER (ORDER BY u_bin) AS t FROM stats GROUP BY u_bin) a WHERE t*2>=(SELECT sum(n) FROM stats)))::INTEGER AS leaf FROM stats s) z GROUP BY leaf, v_bin) y WHERE t*2>=w GROUP BY leaf) p2 ON p2.leaf=l1.leaf) q GROUP BY leaf"""),
    "annulus_edges": sql(f"SELECT annulus_id, {R6('r_lo', 'r_hi')} FROM rings"),
    "annulus_assign": sql("SELECT u_bin, v_bin, round(radius,6) AS radius, annulus_id FROM ringed"),
    "annulus_limits": sql(f"SELECT annulus_id, n_cells, {R6('ci_lower', 'ci_upper')} FROM limits"),
    "annulus_stats_cells": sql("SELECT annulus_id, count(*) AS n, round(avg(median),6) AS mean, round(median(median),6) AS median FROM ringed WHERE annulus_id IS NOT NULL GROUP BY ALL"),
    "annulus_stats_values": sql("""SELECT annulus_id, n, round(mean,6) AS mean, round(m,6) AS median, round(mad,6) AS mad, round(m/sqrt(2*ln(2))*sqrt(-2*ln(1-0.04550026/2)),6) AS low, round(m/sqrt(2*ln(2))*sqrt(-2*ln(0.04550026/2)),6) AS high
        FROM (SELECT annulus_id, any_value(a.n) AS n, any_value(a.mean) AS mean, any_value(a.m) AS m, 1.4826*median(abs(value-a.m)) AS mad FROM (SELECT annulus_id, value FROM kept JOIN ringed USING (u_bin,v_bin) WHERE annulus_id IS NOT NULL) v
        JOIN (SELECT annulus_id, count(*) AS n, avg(value) AS mean, median(value) AS m FROM kept JOIN ringed USING (u_bin,v_bin) WHERE annulus_id IS NOT NULL GROUP BY 1) a USING (annulus_id) GROUP BY 1) x"""),
    "radial_profile": sql("""SELECT b::INTEGER AS bin, count(*) AS n, round(median(median),6) AS median, round(stddev_pop(median),6) AS std, round(any_value(lo)+(b+0.5)*any_value(w),6) AS centre FROM (
        SELECT c.median, c.radius, lo, w, floor((radius-lo)/w) AS b FROM cells c, (SELECT min(radius) AS lo, (max(radius)-min(radius))/20 AS w FROM cells) z) x WHERE radius>lo+b*w AND radius<lo+(b+1)*w GROUP BY b"""),
    "histogram": sql("""SELECT b::INTEGER AS bin, round(a+b*w,6) AS left, round(a+(b+1)*w,6) AS right, count(*) AS n, round(count(*)/(any_value(t)*any_value(w)),6) AS density FROM (
        SELECT least(floor((value-a)/(m-a)*50),49) AS b, a, (m-a)/50 AS w, t FROM kept, (SELECT min(value) AS a, max(value) AS m, count(*) AS t FROM kept) z) x GROUP BY b, a, w"""),
    "fit_distributions": sql("SELECT round(avg(value),6) AS norm_mean, round(stddev_pop(value),6) AS norm_std, round(sqrt(avg(value*value)/2),6) AS rayleigh_sigma, round(avg(ln(value)),6) AS lognorm_mean, round(stddev_pop(ln(value)),6) AS lognorm_std FROM kept WHERE value>0"),
    "rayleigh_pdf": sql("SELECT newrow, round(value/(s*s)*exp(-(value*value)/(2*s*s)),6) AS density FROM kept, (SELECT sqrt(avg(value*value)/2) AS s FROM kept) z"),
    "hexbin": sql("""SELECT (CASE WHEN dq>dr AND dq>ds THEN -rr-rs ELSE rq END)::INTEGER AS q, (CASE WHEN dq>dr AND dq>ds THEN rr WHEN dr>ds THEN -rq-rs ELSE rr END)::INTEGER AS r, count(*) AS n FROM (
        SELECT *, abs(rq-q) AS dq, abs(rr-r) AS dr, abs(rs-s) AS ds FROM (SELECT *, round_even(q,0) AS rq, round_even(r,0) AS rr, round_even(s,0) AS rs FROM (SELECT q, r, -q-r AS s FROM (
        SELECT (sqrt(u*u+v*v))*(sqrt(3)/3)-(value*100.0)/3 AS q, (value*100.0)*(2.0::DOUBLE/3) AS r FROM binned WHERE NOT flag) a) b) c) d GROUP BY ALL"""),
    "grid_colors": sql("SELECT u_bin, v_bin, CASE WHEN median=0 THEN '#808080' WHEN median>t THEN '#000000' ELSE printf('#%02x%02x%02x', floor(median/t*255)::INTEGER, 0, 255-floor(median/t*255)::INTEGER) END AS colour FROM stats, (SELECT any_value(m)+3*1.4826*median(abs(median-m)) AS t FROM stats, (SELECT median(median) AS m FROM stats) y) z"),
    "cells_in_range": sql("SELECT u_bin, v_bin, n FROM stats WHERE u_bin BETWEEN 5 AND 9 AND v_bin BETWEEN 4 AND 12"),
    "cells_in_annulus": sql("SELECT u_bin, v_bin, round(median,6) AS median FROM ringed WHERE annulus_id=3"),
    "limit_cells": sql("SELECT u_bin, v_bin, n FROM stats ORDER BY u_bin, v_bin LIMIT 90"),
    "uvrange_filter": sql("SELECT newrow FROM vis WHERE sqrt(u*u+v*v) BETWEEN 500 AND 1500"),
    "rayleigh_thresholds": sql("SELECT u_bin, v_bin, round(median/sqrt(2*ln(2))*sqrt(-2*ln(1-0.045/2)),6) AS lo, round(median/sqrt(2*ln(2))*sqrt(-2*ln(0.045/2)),6) AS hi FROM stats"),
    "fixed_thresholds": sql("SELECT u_bin, v_bin, round(median/sqrt(2*ln(2))*sqrt(-2*ln(1-0.00269980/2)),6) AS lo, round(median/sqrt(2*ln(2))*sqrt(-2*ln(0.00269980/2)),6) AS hi FROM stats"),
    "load_binned": sql("SELECT newrow, ddid, row, chan, round(u,6) AS u, round(v,6) AS v, u_bin, v_bin, round(value,4) AS stokes_i, flag FROM found_binned"),
    "stokes_all": sql("SELECT newrow, round((amp/2)::FLOAT::DOUBLE-(amp/2)::FLOAT::DOUBLE,4) AS q, round((amp/8)::FLOAT::DOUBLE+(amp/16)::FLOAT::DOUBLE,4) AS u, round((amp/8)::FLOAT::DOUBLE-(amp/16)::FLOAT::DOUBLE,4) AS v, fl[2] OR fl[3] AS flag_uv, list_contains(fl,true) AS flag_any FROM long"),
    "amplitude": sql("SELECT newrow, round(sqrt(pow((amp/2)::FLOAT::DOUBLE+(amp/2)::FLOAT::DOUBLE,2)+pow((amp/4)::FLOAT::DOUBLE+(amp/4)::FLOAT::DOUBLE,2)),3) AS amplitude FROM long"),
    "filter_ddid_in": sql("SELECT newrow FROM long WHERE ddid IN (1)"),
    "filter_field": sql("SELECT ddid, count(*) AS n FROM nested WHERE field_id=2 GROUP BY ddid"),
    "row_spans": sql("SELECT field_id, b.ddid, count(*) AS n_rows, any_value(nchan)::INTEGER AS n_chan, 4 AS n_pol, any_value(base) AS first_row, any_value(base+b.n_rows*nchan-1)::BIGINT AS last_row FROM nested n JOIN bases b ON b.ddid=n.ddid GROUP BY field_id, b.ddid"),
    "ddid_by_nchan": sql("SELECT nchan::INTEGER AS nchan, string_agg(ddid::VARCHAR, ',' ORDER BY ddid) AS ddids FROM bases GROUP BY nchan"),
    "write_flags_or": sql("SELECT newrow, fl[1] OR newrow IN (SELECT newrow FROM found_flags) AS f0, fl[2] AS f1, fl[3] AS f2, fl[4] OR newrow IN (SELECT newrow FROM found_flags) AS f3 FROM long"),
    "write_flags_overwrite": sql("SELECT newrow, newrow IN (SELECT newrow FROM found_flags) AS f0, fl[2] AS f1, fl[3] AS f2, newrow IN (SELECT newrow FROM found_flags) AS f3 FROM long"),
    "renest_flags": sql("SELECT ddid, row, string_agg(CASE WHEN fl[1] OR hit THEN '1' ELSE '0' END||CASE WHEN fl[2] THEN '1' ELSE '0' END||CASE WHEN fl[3] THEN '1' ELSE '0' END||CASE WHEN fl[4] OR hit THEN '1' ELSE '0' END, '/' ORDER BY chan) AS flags FROM (SELECT *, newrow IN (SELECT newrow FROM found_flags) AS hit FROM long) x GROUP BY ddid, row"),
    "main_table_info": sql("SELECT ddid, count(*) AS n_rows, round(max(time)-min(time),3) AS exposure, strftime(min(ts),'%d-%b-%Y %H:%M:%S') AS began, strftime(max(ts),'%d-%b-%Y %H:%M:%S') AS ended FROM nested GROUP BY ddid"),
    "scan_list": sql("SELECT scan_number, n.field_id, r_name AS field_name, strftime(t0,'%d-%b-%Y %H:%M:%S') AS began, strftime(t1,'%d-%b-%Y %H:%M:%S') AS ended, n_rows, coalesce(obs_mode,'') AS intent FROM (SELECT scan_number, field_id, count(*) AS n_rows, min(ts) AS t0, max(ts) AS t1, arg_min(state_id, struct_pack(t:=ts, r:=row_id)) AS state_id FROM nested GROUP BY ALL) n JOIN region ON r_regionkey=n.field_id LEFT JOIN states USING (state_id)"),
    "field_list": sql("""SELECT r_regionkey::INTEGER AS field_id, r_name AS name, coalesce(n,0) AS n_rows, printf('%d:%02d:%02d.%02d', h//360000, h//6000%60, h//100%60, h%100) AS ra, printf('%s%d.%02d.%02d.%02d', CASE WHEN g<0 AND d>0 THEN '-' ELSE '' END, d//360000, d//6000%60, d//100%60, d%100) AS declination
        FROM (SELECT *, round(degrees(r_regionkey::DOUBLE*0.1)/15*360000)::BIGINT AS h, degrees(r_regionkey::DOUBLE*0.2-0.5) AS g, round(abs(degrees(r_regionkey::DOUBLE*0.2-0.5))*360000)::BIGINT AS d FROM region) f LEFT JOIN (SELECT field_id, count(*) AS n FROM nested GROUP BY 1) c ON c.field_id=r_regionkey"""),
    "list_fields": sql("SELECT r_regionkey::INTEGER AS field_id, r_name AS name, coalesce(obs_mode,'') AS intent FROM region LEFT JOIN (SELECT field_id, arg_max(state_id, struct_pack(s:=scan_number, t:=ts, r:=row_id)) AS state_id FROM nested GROUP BY 1) l ON l.field_id=r_regionkey LEFT JOIN states USING (state_id)"),
    "spectral_windows": sql("SELECT ddid, spw_id, name, len(chan_freq)::INTEGER AS n_chan, chan_freq[1]/1e6 AS first_mhz, chan_width/1e3 AS width_khz, total_bandwidth/1e3 AS bandwidth_khz, round((list_min(chan_freq)+list_max(chan_freq))/2e6,6) AS centre_mhz, 'XX,XY,YX,YY' AS correlations, n_rows FROM dd JOIN spw USING (spw_id) JOIN (SELECT ddid, count(*) AS n_rows FROM nested GROUP BY ddid) c USING (ddid)"),
    "longest_baseline": sql("SELECT round(max(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))),6) AS distance FROM ant a JOIN ant b ON a.antenna_id<b.antenna_id"),
    "longest_projections": sql("""SELECT moment, round(max(sqrt(pow(a.u-b.u,2)+pow(a.v-b.v,2)))*1.5e9::DOUBLE/299792458::DOUBLE,3) AS wavelengths FROM turned a JOIN turned b USING (moment) WHERE a.antenna_id<=b.antenna_id GROUP BY moment"""),
    "spw_exclude_bad": sql("SELECT ddid, chan, n, mhz-1 AS low, mhz+1 AS high FROM (SELECT ddid, chan, max(round(299792458::DOUBLE/lam/1e6,6)) AS mhz, count(*) AS n FROM long GROUP BY ALL) x WHERE NOT EXISTS (SELECT 1 FROM (VALUES (850.0,985.0),(1090.0,1250.0),(1490.0,1580.0)) b(l,h) WHERE mhz-1>=l AND mhz+1<=h)"),
    "scan_main": sql("SELECT row_id, field_id, ddid, scan_number, round(u_m,6) AS u_m, round(v_m,6) AS v_m FROM nested"),
    "scan_ordered": sql("SELECT (row_number() OVER (ORDER BY scan_number, time, row_id))::BIGINT AS place, row_id FROM nested"),
    "residual_column": sql("SELECT newrow, round((amp/2)::FLOAT::DOUBLE,4) AS first_re, round((amp/16)::FLOAT::DOUBLE,4) AS third_re FROM long"),
    "union_ddids": sql("SELECT newrow, ddid, round(u,6) AS u, round(v,6) AS v FROM long"),
    "join_ddid_spw": sql("SELECT ddid, chan, round(lam,9) AS lam, count(*) AS n FROM long GROUP BY ALL"),
    "field_lookup": "SELECT r_regionkey::INTEGER AS field_id, r_name AS name FROM region WHERE r_name='ASIA'",
    "source_list": "SELECT r_regionkey::INTEGER AS source_id, r_name AS name, (r_regionkey%2)::INTEGER AS spw_id, CASE WHEN r_regionkey%2=0 THEN 1.42e9::DOUBLE+r_regionkey*1e6::DOUBLE ELSE 0 END AS rest_frequency, CASE WHEN r_regionkey%3=0 THEN r_regionkey*1000.0::DOUBLE ELSE 0 END AS system_velocity FROM region",
    "observation_info": "SELECT 'observer' AS observer, 'project' AS project, 'array' AS telescope_name, strftime(min(ts),'%d-%b-%Y %H:%M:%S') AS began, strftime(max(ts),'%d-%b-%Y %H:%M:%S') AS ended FROM events",
    "spw_bounds": "SELECT CASE WHEN s_suppkey%2=0 THEN '0:' ELSE '' END||(s_suppkey+880)||CASE WHEN s_suppkey%3=0 THEN '' ELSE '~'||(s_suppkey+933) END||'MHz' AS text, (s_suppkey+880)::DOUBLE AS low, CASE WHEN s_suppkey%3=0 THEN s_suppkey+880 ELSE s_suppkey+933 END::DOUBLE AS high, 'MHz' AS unit FROM supplier",
    "cell_runs": sql("SELECT u_bin, v_bin, start, lead(start) OVER (ORDER BY u_bin, v_bin) AS next_start FROM (SELECT u_bin, v_bin, (sum(n) OVER (ORDER BY u_bin,v_bin)-n)::BIGINT AS start FROM stats) x"),
    "cell_limits": sql("SELECT u_bin, v_bin, round(cu,6) AS ci_upper, doubted FROM known"),
    "bin_counts": sql("SELECT u_bin, v_bin, n FROM stats"),
    "group_values": sql("SELECT u_bin, v_bin, row_number() OVER (PARTITION BY u_bin, v_bin ORDER BY newrow) AS place, round(value*1000)::BIGINT AS thousandths FROM kept"),
    "amplitude_median_std": sql("SELECT u_bin, v_bin, round(median(abs(value)),6) AS median, round(stddev_pop(abs(value)),6) AS std FROM kept GROUP BY ALL"),
    "apply_fn": sql("SELECT u_bin, v_bin, round(max(value)-min(value),6) AS extent FROM kept GROUP BY ALL"),
    "null_flags_multi": sql("SELECT newrow FROM binned WHERE NOT flag AND value+u*0=0"),
    "hist_range": sql("SELECT least(floor((value-2)/(12.0::DOUBLE-2)*20),19)::INTEGER AS bin, count(*) AS n FROM kept WHERE value BETWEEN 2 AND 12 GROUP BY ALL"),
    "histogram_weighted": sql("SELECT least(floor((value-2)/(12.0::DOUBLE-2)*20),19)::INTEGER AS bin, round(sum(value),5) AS n FROM kept WHERE value BETWEEN 2 AND 12 GROUP BY ALL"),
    "rayleigh_clip_upper": sql("SELECT k.u_bin, k.v_bin, count_if(value < m/sqrt(2*ln(2))*sqrt(-2*ln(0.045/2)))::BIGINT AS n_left FROM kept k JOIN mids USING (u_bin,v_bin) JOIN stats s USING (u_bin,v_bin) WHERE s.mean/s.median>1.2 GROUP BY ALL"),
    "sigma_clip": sql("""SELECT u_bin, v_bin, count(*) AS n_left, round(avg(x),6) AS mean FROM (SELECT u_bin, v_bin, unnest(vals) AS x FROM allclipped) z GROUP BY ALL"""),
    "sigma_clip_median": sql("SELECT u_bin, v_bin, count(*) AS n_left, round(avg(x),6) AS mean FROM (SELECT u_bin, v_bin, unnest(vals) AS x FROM medclipped) z GROUP BY ALL"),
    "cell_trimmed_mean": sql("SELECT u_bin, v_bin, round(avg(value),6) AS mean FROM kept JOIN (SELECT u_bin, v_bin, quantile_cont(value, [0.1,0.9]) AS q FROM kept GROUP BY ALL) c USING (u_bin,v_bin) WHERE value>=q[1]-1e-9 AND value<=q[2]+1e-9 GROUP BY ALL"),
    "distribution_fits": sql("""SELECT name, parameter, round(estimate,6) AS estimate FROM (SELECT unnest(['normal','normal','rayleigh','lognormal','lognormal','exponential']) AS name, unnest(['mean','std','sigma','mean','std','scale']) AS parameter, unnest([mean,std,sigma,log_mean,log_std,mean]) AS estimate FROM closed
        UNION ALL SELECT 'weibull', unnest(['shape','scale']), unnest([shape,scale]) FROM weibull UNION ALL SELECT 'gamma', unnest(['shape','scale']), unnest([shape,scale]) FROM gammas) x"""),
    "histogram_fits": sql("""SELECT bin, n, round(n/t,6) AS density, round(x/(sigma*sigma)*exp(-(x*x)/(2*sigma*sigma)),6) AS pdf_rayleigh, round(exp(-pow((ln(x)-log_mean)/log_std,2)/2)/(x*log_std*sqrt(2*pi())),6) AS pdf_lognormal,
        round(w.shape/w.scale*pow(x/w.scale,w.shape-1)*exp(-pow(x/w.scale,w.shape)),6) AS pdf_weibull, round(exp((g.shape-1)*ln(x)-x/g.scale-g.shape*ln(g.scale)-lgamma(g.shape)),6) AS pdf_gamma
        FROM (SELECT bin, n, bin+0.5::DOUBLE AS x, sum(n) OVER () AS t FROM (SELECT least(floor(value),39)::INTEGER AS bin, count(*) AS n FROM kept WHERE value BETWEEN 0 AND 40 GROUP BY ALL) b) h, closed, weibull w, gammas g"""),
    "sources_stored": "SELECT r_regionkey::INTEGER AS source_id, r_name AS name, (r_regionkey%2)::INTEGER AS spw_id, CASE WHEN r_regionkey=0 THEN 1.42e9::DOUBLE ELSE 0 END AS rest_frequency, 0::DOUBLE AS system_velocity FROM region",
    "storage_order": sql("SELECT row_number() OVER (ORDER BY floor(time/3600), e.user_id%4, e.user_id%4+1+e.event_id%5, row_id) AS place, row_id FROM nested n JOIN events e ON e.event_id=n.row_id"),
    "storage_inversions": "SELECT count(*) AS n_rows, 0::BIGINT AS inversions FROM events",
    "semi_flagged": sql("SELECT chan, count(*) AS n FROM vis WHERE newrow IN (SELECT newrow FROM flags) GROUP BY chan"),
    "anti_flagged": sql("SELECT chan, count(*) AS n FROM vis WHERE newrow NOT IN (SELECT newrow FROM flags) GROUP BY chan"),
    "apply_flags": sql("SELECT newrow, newrow IN (SELECT newrow FROM flags) AS flagged FROM vis"),
    "group_idx_val": sql("SELECT u_bin, v_bin, row_number() OVER (PARTITION BY u_bin, v_bin ORDER BY newrow) AS place, newrow, round(value,6) AS value FROM kept"),
    "group_members": sql("SELECT u_bin, v_bin, row_number() OVER (PARTITION BY u_bin, v_bin ORDER BY newrow) AS place, newrow, round(value,6) AS value, flag FROM binned"),
    "amplitude_groups": sql("SELECT u_bin, v_bin, count(*) AS n, round(median(strength),3) AS median, round(stddev_pop(strength),3) AS std FROM found_binned WHERE NOT flag AND strength<>0 GROUP BY ALL"),
    "rms_norm": sql("SELECT u_bin, v_bin, round(sqrt(avg(pow(value-m,2))),6) AS rms FROM kept JOIN mids USING (u_bin,v_bin) GROUP BY ALL"),
    "histogram_cell": sql("SELECT u_bin, v_bin, least(floor(value/20.0::DOUBLE*20),19)::INTEGER AS bin, count(*) AS n FROM kept WHERE u_bin BETWEEN 5 AND 7 AND v_bin BETWEEN 5 AND 9 AND value BETWEEN 0 AND 20 GROUP BY ALL"),
    "histogram_ring": sql("SELECT annulus_id, least(floor(value/20.0::DOUBLE*20),19)::INTEGER AS bin, count(*) AS n FROM kept JOIN ringed USING (u_bin,v_bin) WHERE annulus_id IS NOT NULL AND value BETWEEN 0 AND 20 GROUP BY ALL"),
    "obs_sections": sql("SELECT 'main' AS section, count(DISTINCT ddid) AS n_rows FROM nested UNION ALL SELECT 'scans', count(*) FROM (SELECT DISTINCT scan_number, field_id FROM nested JOIN region ON r_regionkey=field_id) x UNION ALL SELECT 'fields', count(*) FROM region UNION ALL SELECT 'intents', count(*) FROM region UNION ALL SELECT 'sources', count(*) FROM region UNION ALL SELECT 'windows', count(*) FROM dd UNION ALL SELECT 'antennas', count(*) FROM ant"),
    "spw_split": sql("SELECT ddid, spw_id, part, round(chan_freq[1]/1e6+part*(total_bandwidth/1e6/4),6) AS low_mhz, round(chan_freq[1]/1e6+(part+1)*(total_bandwidth/1e6/4),6) AS high_mhz, n_rows FROM dd JOIN spw USING (spw_id) JOIN (SELECT ddid, count(*) AS n_rows FROM nested GROUP BY ddid) c USING (ddid), (SELECT unnest(range(4))::INTEGER AS part) p"),
    "radial_annulus_profile": sql("""SELECT name, annulus_id, n, round(mean,6) AS mean FROM (SELECT 'before' AS name, annulus_id, count(*) AS n, avg(median) AS mean FROM ringed WHERE annulus_id IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'after', annulus_id, count(*), avg(coalesce(m,0)) FROM ringed LEFT JOIN (SELECT u_bin, v_bin, median(value) AS m FROM judged WHERE NOT outlier GROUP BY ALL) j USING (u_bin,v_bin) WHERE annulus_id IS NOT NULL GROUP BY ALL) x"""),
}

ORACLE_SQL["flags_stored"] = ORACLE_SQL["renest_flags"]
#: The summary's sections, each over the SQL of its list.
_SECTIONS = {
    "main": ("main_table_info", "ddid, n_rows, began, ended"), "scans": ("scan_list", "scan_number, field_name, began, ended, n_rows, intent"), "fields": ("field_list", "field_id, 'T', name, ra, declination, 'J2000', n_rows"),
    "intents": ("list_fields", "field_id, name, intent"), "sources": ("source_list", "source_id, name, spw_id"), "windows": ("spectral_windows", "ddid, spw_id, name, n_chan, correlations"),
}
ORACLE_SQL["obs_summary"] = " UNION ALL ".join(
    [f"SELECT '{section}' AS section, concat_ws(' | ', {columns}) AS line FROM ({ORACLE_SQL[source]}) q_{section}" for section, (source, columns) in _SECTIONS.items()]
    + ["SELECT 'antennas', concat_ws(' | ', s_suppkey, s_name, 'P'||s_suppkey) FROM supplier"]
)
