"""python -m chronolake FOLDER [SCRIPT.vq]: a prompt, or a script, over the database in FOLDER."""

import sys

from pyspark.sql import SparkSession

from .catalog import Database

if not 2 <= len(sys.argv) <= 3:
    sys.exit(__doc__)
database = Database(SparkSession.builder.appName("chronolake").getOrCreate(), sys.argv[1])
if len(sys.argv) == 3:
    database.run_file(sys.argv[2])
else:
    database.run_prompt()
