"""compare.py SF NAME...: Spark rows against DuckDB rows."""
import sys, time, os, glob
ROOT=os.path.dirname(os.path.abspath(__file__)); sys.path.insert(0,ROOT); os.environ['PYTHONPATH']=ROOT
import duckdb, __spark_entry__ as E
from pyspark.sql import SparkSession
sf=sys.argv[1]; d=f'/root/testdata/{sf}'
names=sys.argv[2:]
q=E.queries(); o=E.oracle_sql()
if names==['all']: names=list(q)
elif names and names[0].startswith('^'):
    import re; names=[n for n in q if re.search(names[0],n)]
s=(SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions","8").config("spark.driver.memory","8g").config("spark.sql.session.timeZone","UTC").config("spark.ui.enabled","false").config("spark.ui.showConsoleProgress","false").getOrCreate())
s.sparkContext.setLogLevel("ERROR")
c=duckdb.connect(); c.sql("set timezone='UTC'")
for f in glob.glob(d+'/*.parquet'):
    n=os.path.basename(f)[:-8]; c.sql(f"create view {n} as select * from '{f}'" if os.path.isfile(f) else f"create view {n} as select * from '{f}/*.parquet'")
import math, datetime, decimal
def norm(v):
    if isinstance(v,float): return 'nan' if math.isnan(v) else f'{v:.9g}'
    if isinstance(v,decimal.Decimal): return f'{float(v):.9g}'
    if isinstance(v,(list,tuple)): return str([norm(x) for x in v])
    if isinstance(v,dict): return str(sorted((k,norm(x)) for k,x in v.items()))
    if isinstance(v,datetime.datetime) and v.tzinfo: return str(v.astimezone(datetime.timezone.utc).replace(tzinfo=None))
    return str(v)
bad=0
for n in names:
    t=time.time()
    try:
        df=q[n](s,d); cols=sorted(df.columns); rows=sorted(tuple(norm(r[x]) for x in cols) for r in df.collect())
    except Exception as e:
        print(n,'ERROR',str(e)[:1500]); bad+=1; continue
    t1=time.time()-t
    if n not in o: print(n,len(rows),'rows, no sql',f'{t1:.1f}s', rows[:2]); continue
    t=time.time()
    try:
        r=c.sql(o[n]); oc=[x for x in r.columns]; idx=[oc.index(x) for x in cols] if sorted(oc)==cols else None
        if idx is None: print(n,'COLUMNS',cols,sorted(oc)); bad+=1; continue
        orow=sorted(tuple(norm(x[i]) for i in idx) for x in r.fetchall())
    except Exception as e:
        print(n,'SQL ERROR',str(e)[:800]); bad+=1; continue
    ok=rows==orow; bad+=not ok
    print(n,'OK' if ok else 'DIFF',len(rows),len(orow),f'{t1:.1f}s sql {time.time()-t:.1f}s', [(a,b) for a,b in dict(df.dtypes).items() if 0])
    if not ok:
        a,b=set(rows),set(orow); print('  only spark',len(a-b),sorted(a-b)[:3]); print('  only sql',len(b-a),sorted(b-a)[:3])
print('BAD',bad)
