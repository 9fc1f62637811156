import os
import sys

# tests here import one another by name
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
