"""Where cells come from: workbook files, generated corpora, tables shaped as grids."""
