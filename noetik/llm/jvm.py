"""A compiled function for executors' JVMs, from source at run time.

Spark ships Janino, the compiler of its own generated code. The source below goes through it on the driver; the class
file is put into a jar that Spark serves to the executors like any other. No build tool or JDK is needed.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_ready: dict[str, object] = {}


def register(spark: SparkSession, name: str, class_name: str, source: str, returns: str) -> None:
    """Make class_name (a UDFn from Spark's Java API) callable as name in SQL expressions of this session."""
    context = spark.sparkContext
    jvm = context._jvm
    key = f"{context.applicationId}/{class_name}"
    if key not in _ready:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(source)
        classes = compiler.getBytecodes()
        jar = Path(tempfile.mkdtemp(prefix="noetik-")) / f"{class_name}.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for c in classes.keySet().toArray():
                z.writestr(c.replace(".", "/") + ".class", bytes(classes.get(c)))
        context._jsc.addJar(str(jar))
        urls = context._gateway.new_array(jvm.java.net.URL, 1)
        urls[0] = jvm.java.io.File(str(jar)).toURI().toURL()
        parent = jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader()
        _ready[key] = jvm.java.net.URLClassLoader(urls, parent).loadClass(class_name)
    kind = spark._jsparkSession.parseDataType(spark.range(0).select(F.lit(None).cast(returns)).schema[0].dataType.json())
    spark._jsparkSession.udf().register(name, _ready[key].getDeclaredConstructors()[0].newInstance(None), kind)
