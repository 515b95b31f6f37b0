"""tessera: repository and corpus analytics on Spark.

Every operator is a function from DataFrame to DataFrame.  Nothing here needs a
particular session; `tessera.session` only reads the settings of the one it gets.
"""
